"""Repeated passages of words by prefix-partitioned suffix trees.

A window is ``size`` consecutive words; it is repeated if its words also start
earlier: in a document with a smaller id, or before it in the same one.

1. Every window has an anchor, its 8-word group with the smallest hash (the leftmost of
   equals). Equal windows have equal anchors at equal places, so a window whose anchor occurs once
   is not repeated. Anchors are a seventh of the words, and only they are shuffled.
2. Windows of repeated anchors go on as segments: the stretch of windows with one anchor,
   as 32-bit word codes. Equal segments of a batch are answered there, and the
   earliest is sent, so a passage that very many documents share sends a few rows.
3. A task takes the segments of its anchors in order of document and place, in memory-sized
   runs. Their suffixes are split by prefixes, one word long or as many as it
   takes to get small groups; each group's suffix tree is built from its sorted suffixes
   and their common prefixes. Internal nodes of depth ``size`` or more are the repeats; all
   occurrences but the earliest are marked. Earliest ones stay for the next run.
   An anchor with more than ``RUN_SUFFIXES`` distinct windows is hot: its windows go apart, each under its
   own hash, where the first of neighbours with 128 equal bits is the earliest, so no run holds a hot anchor.
4. Marks return to their documents, as runs of windows.

Documents meet the lists of anchors and of marks on one shuffle of the texts, which the plan
uses twice. Anchors and segments that a task has already answered get random keys,
so no key is hot.

Cases: null and short texts have no window; repeated rows, with equal ids and texts, are one
document, whose windows do not mark each other; other texts under one id are documents of their own,
in order of their hash; null doc_id is the smallest id; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import (
    BATCH_BYTES, Words, mix64, prefix, row_keys, row_slices, span_hash, string_buffer, with_row_key, without_row_key, words_of, written, _P, _Q,
)
from touchtally.sources.checkpoints import broadcast_if_small

SIZE = 20
ANCHOR = 8
# Suffixes of one run and of one prefix group.
RUN_SUFFIXES = 1 << 19
GROUP_SUFFIXES = 1 << 14
# Segments of hot anchors whose windows are compared at once.
HOT_SLICE = 2000
# Hot anchors are one long each.
MAX_BROADCAST_ANCHORS = 1_000_000


def window_anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, its anchor's first word, and the hash of the group at every word."""
    n = len(words.hash)
    counts = np.maximum(np.diff(words.first) - size + 1, 0)
    window = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    if not len(window):
        return window, window, np.zeros(0, np.uint64)
    at = np.arange(n - ANCHOR + 1)
    groups = span_hash(words.sums, at, at + ANCHOR, _Q)
    bits = np.uint64(int(n).bit_length())
    low = (groups >> bits << bits) | at.astype(np.uint64)
    span, width = size - ANCHOR + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return window, (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), groups


def _spread(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys for rows that need no partner."""
    return mix64(mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D)) ^ places.astype(np.uint64))


def _first_of_equal(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by ``order``: whether a row differs from the one before, and whether it has equals."""
    head = np.ones(len(order), dtype=bool)
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    head[1:] = ~same
    equals = ~head
    equals[:-1] |= ~head[1:]
    return head, equals


def _loads(order: np.ndarray, head: np.ndarray, key: np.ndarray, content: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For the first row of each key in ``order``, the summed size of its distinct contents; 0 for others."""
    by_content = np.lexsort((content, key))
    new, _ = _first_of_equal(by_content, key, content)
    group, _ = _first_of_equal(by_content, key)
    out = np.zeros(len(order), dtype=np.int64)
    out[order[head]] = np.bincount(np.cumsum(group) - 1, weights=np.where(new, size[by_content], 0)).astype(np.int64)
    return out


def window_names(values: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes, 128 bits together, of the windows that start at ``at``."""
    other = mix64(values ^ np.uint64(0x2545F4914F6CDD1D))
    return span_hash(prefix(values, _P), at, at + size, _P), span_hash(prefix(other, _Q), at, at + size, _Q)


def _window_runs(marked: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and length of the runs of marked windows of one segment."""
    at = np.flatnonzero(marked)
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    begin = np.flatnonzero(opens)
    return at[begin], np.diff(np.append(begin, len(at)))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = string_buffer(batch.column("text"))
        for lo, hi in row_slices(offsets, 2 * BATCH_BYTES):
            yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _anchor_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _batches(batches):
            words = words_of(raw, offsets)
            window, anchor, groups = window_anchors(words, size)
            if not len(anchor):
                continue
            begin = np.flatnonzero(np.diff(anchor, prepend=-1))
            n = np.diff(np.append(begin, len(anchor)))
            anchor, first = anchor[begin], window[begin]
            content = span_hash(words.sums, first, first + n + size - 1, _Q)
            key = groups[anchor].copy()
            row = words.row[anchor]
            ids, place = part.column("key").to_numpy()[row], anchor - words.first[row]
            order = np.lexsort((place, ids, key))
            head, sure = _first_of_equal(order, key)
            load = _loads(order, head, key, content, n)
            rest = order[~head]
            key[rest] = _spread(ids[rest], place[rest])
            known = np.zeros(len(key), dtype=bool)
            known[order] = sure
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(ids), pa.array(place, pa.int32()), pa.array(known), pa.array(load)],
                                  names=["anchor", "key", "place", "known", "load"])

    return run


# Stands for the place in rows whose key is a hot anchor.
HOT_ROW = -1


def _repeated_only(batches: Iterator[pa.RecordBatch], limit: int = 2**62) -> Iterator[pa.RecordBatch]:
    """Rows known to be repeated, or beside one with the same anchor; the input is sorted by anchor.

    An anchor whose loads sum to more than ``limit`` is named by one row more.
    """
    rest: pa.RecordBatch | None = None
    last = None
    loaded: tuple[int | None, int] = (None, 0)  # the last anchor, and its load so far

    def pick(table: pa.RecordBatch, final: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        anchor = table.column("anchor").to_numpy()
        same = anchor[1:] == anchor[:-1]
        keep = table.column("known").to_numpy(zero_copy_only=False).copy()
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and len(anchor) and anchor[0] == last:
            keep[0] = True
        n = len(anchor) if final else len(anchor) - 1
        chosen = table.slice(0, n).filter(pa.array(keep[:n]))
        return chosen.select(["key", "place"]), None if final else table.slice(n)

    def hot(table: pa.RecordBatch) -> pa.RecordBatch:
        """Anchors that pass the limit in these rows."""
        nonlocal loaded
        anchor, load = table.column("anchor").to_numpy(), table.column("load").to_numpy()
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sums, before = np.add.reduceat(load, begin), np.zeros(len(begin), dtype=np.int64)
        if anchor[0] == loaded[0]:
            before[0] = loaded[1]
        loaded = int(anchor[-1]), int(before[-1] + sums[-1])
        found = anchor[begin[(before <= limit) & (before + sums > limit)]]
        return pa.record_batch([pa.array(found), pa.array(np.full(len(found), HOT_ROW), pa.int32())], names=["key", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        found = hot(batch)
        if found.num_rows:
            yield found
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        out, rest = pick(batch, False)
        if batch.num_rows > 1:
            last = batch.column("anchor")[batch.num_rows - 2].as_py()
        yield out
    if rest is not None:
        yield pick(rest, True)[0]


_ANCHOR = "anchor long, key long, place int, known boolean, load long"


def _repeated_places(anchors: DataFrame, limit: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Places of repeated anchors as a set per key (repeated rows share a key and their places), and the anchors whose segments are more than ``limit``."""
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = anchors.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: _repeated_only(batches, limit), "key long, place int"
    )
    rows = written(rows, name)
    hot = rows.filter(F.col("place") == HOT_ROW).select(F.col("key").alias("anchor"), F.lit(True).alias("hot"))
    return rows.filter(F.col("place") != HOT_ROW).groupBy("key").agg(F.collect_set("place").alias("places")), hot


_SEGMENT = "anchor long, key long, first int, n int, codes binary"


def _segment_rows(size: int):
    """Segments of repeated anchors; rows without codes are marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _batches(batches):
            words = words_of(raw, offsets)
            window, anchor, groups = window_anchors(words, size)
            if not len(window):
                continue
            listed = part.column("places")
            owner = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy())
            repeated = np.zeros(len(words.hash), dtype=bool)
            places = words.first[owner] + listed.flatten().to_numpy()
            repeated[places[places < words.first[owner + 1]]] = True
            head = np.flatnonzero(np.diff(anchor, prepend=-1))
            n = np.diff(np.append(head, len(anchor)))
            wanted = repeated[anchor[head]]
            first, n, at = window[head[wanted]], n[wanted], anchor[head[wanted]]
            if not len(first):
                continue
            content = span_hash(words.sums, first, first + n + size - 1, _Q)
            row = words.row[first]
            ids, place = part.column("key").to_numpy()[row], first - words.first[row]
            order = np.lexsort((place, ids, n, content))
            head, _ = _first_of_equal(order, content, n)
            # Of equal segments the earliest goes on; equal place in a repeated row is the same window.
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            marked = np.zeros(len(first), dtype=bool)
            marked[order] = ~head & ((ids[order] != ids[lead]) | (place[order] != place[lead]))
            dropped = np.zeros(len(first), dtype=bool)
            dropped[order] = ~head
            codes = (words.hash >> np.uint64(32)).astype(np.uint32)
            send = np.flatnonzero(~dropped)
            data = [codes[a : a + k + size - 1].tobytes() for a, k in zip(first[send].tolist(), n[send].tolist())]
            yield pa.record_batch(
                [pa.array(groups[at[send]].view(np.int64)), pa.array(ids[send]), pa.array(place[send], pa.int32()), pa.array(n[send], pa.int32()), pa.array(data, pa.binary())],
                names=["anchor", "key", "first", "n", "codes"],
            )
            done = np.flatnonzero(marked)
            if len(done):
                yield pa.record_batch(
                    [pa.array(_spread(ids[done], place[done]).view(np.int64)), pa.array(ids[done]), pa.array(place[done], pa.int32()), pa.array(n[done], pa.int32()),
                     pa.nulls(len(done), pa.binary())],
                    names=["anchor", "key", "first", "n", "codes"],
                )

    return run


def _hot_windows(size: int):
    """Windows of hot anchors, each a row under its own hash; other rows pass.

    ``other`` is the window's second hash. Of equal windows of a batch the earliest is sent, and the others are answered here.
    """

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), dtype=np.uint32)
        n = part.column("n").to_numpy()
        owner = np.repeat(np.arange(part.num_rows), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begins = np.cumsum(n + size - 1) - (n + size - 1)
        name, other = window_names(mix64(codes.astype(np.uint64)), begins[owner] + inside, size)
        ids, place = part.column("key").to_numpy()[owner], part.column("first").to_numpy()[owner] + inside
        order = np.lexsort((place, ids, other, name))
        head, _ = _first_of_equal(order, name, other)
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        done, send = np.zeros(len(order), dtype=bool), order[head]
        done[order] = ~head & ((ids[order] != ids[lead]) | (place[order] != place[lead]))
        yield _window_rows(name[send], ids[send], place[send], np.ones(len(send)), other[send])
        at, k = _window_runs(done, owner)
        if len(at):
            yield _window_rows(_spread(ids[at], place[at]), ids[at], place[at], k, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column("hot").fill_null(False).to_numpy(zero_copy_only=False) & batch.column("codes").is_valid().to_numpy(zero_copy_only=False)
            cold = batch.filter(pa.array(~hot)).select(["anchor", "key", "first", "n", "codes"])
            yield pa.record_batch([*cold.columns, pa.nulls(cold.num_rows, pa.int64())], names=[*cold.schema.names, "other"])
            warm = batch.filter(pa.array(hot))
            for lo in range(0, warm.num_rows, HOT_SLICE):
                yield from rows(warm.slice(lo, HOT_SLICE))

    return run


def _window_rows(anchor: np.ndarray, ids: np.ndarray, place: np.ndarray, n: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
    rows = len(anchor)
    return pa.record_batch(
        [pa.array(anchor.view(np.int64)), pa.array(ids), pa.array(place, pa.int32()), pa.array(n, pa.int32()), pa.nulls(rows, pa.binary()),
         pa.nulls(rows, pa.int64()) if other is None else pa.array(other.view(np.int64))],
        names=["anchor", "key", "first", "n", "codes", "other"],
    )


def _later_windows(rows: pa.RecordBatch, lead: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """Marks of windows after the first of their equals, for rows in order; and the first of the last ones."""
    name, other, ids, place = (rows.column(c).to_numpy() for c in ("anchor", "other", "key", "first"))
    if lead is not None:
        name, other, ids, place = (np.append(np.array([x], dtype=np.int64), y) for x, y in zip(lead, (name, other, ids, place)))
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (other[1:] != other[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(name)), 0))
    later = (ids != ids[first]) | (place != place[first])
    end = int(first[-1])
    marks = pa.record_batch(
        [pa.array(ids[later]), pa.array(place[later], pa.int32()), pa.array(np.ones(later.sum()), pa.int32())], names=["key", "first", "n"]
    )
    return marks, tuple(int(x[end]) for x in (name, other, ids, place))


def prefix_groups(codes: np.ndarray, suffix: np.ndarray, size: int, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of suffixes with one prefix, as (prefix length, suffixes); longer prefixes where a group is above ``limit``."""
    waiting = [(0, suffix)]
    while waiting:
        depth, members = waiting.pop()
        if len(members) <= limit or depth == size:
            yield depth, members
            continue
        word = codes[members + depth]
        order = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.diff(word[order])) + 1
        groups = np.split(members[order], cuts)
        small: list[np.ndarray] = []
        held = 0
        for group in groups:
            if len(group) > limit:
                waiting.append((depth + 1, group))
                continue
            # Neighbouring small groups share a tree whose prefix is the one before.
            if held + len(group) > limit:
                yield depth, np.concatenate(small)
                small, held = [], 0
            small.append(group)
            held += len(group)
        if small:
            yield depth, np.concatenate(small)


def deep_nodes(codes: np.ndarray, members: np.ndarray, depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The group's suffixes in order, and the deep node of each: the suffix tree cut at ``size`` words.

    Suffixes are sorted by words beyond the common prefix; neighbours whose common prefix
    reaches ``size`` lie below one internal node.
    """
    columns = [codes[members + k] for k in range(depth, size)]
    if not columns:
        return members, np.zeros(len(members), dtype=np.int64)
    if len(columns) % 2:
        columns.append(np.zeros(len(members), dtype=np.uint32))
    pairs = [(a.astype(np.uint64) << np.uint64(32)) | b for a, b in zip(columns[::2], columns[1::2])]
    order = np.lexsort((members, *pairs[::-1]))
    deep = np.ones(max(len(order) - 1, 0), dtype=bool)
    for pair in pairs:
        deep &= pair[order[1:]] == pair[order[:-1]]
    return members[order], np.cumsum(np.concatenate([[0], ~deep]))


def _later_occurrences(codes: np.ndarray, begins: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Marks, for the windows of segments given in order of document and place, of those found earlier too."""
    total = np.cumsum(counts)
    suffix = np.repeat(begins - (total - counts), counts) + np.arange(total[-1])
    marked = np.zeros(len(codes), dtype=bool)
    for depth, members in prefix_groups(codes, suffix, size, GROUP_SUFFIXES):
        members, node = deep_nodes(codes, members, depth, size)
        marked[members[1:][node[1:] == node[:-1]]] = True
    return marked


def _tree_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes, bool]] = []  # anchor, id, first, n, codes, answered in an earlier run
        load = 0

        def answer(keep_anchor: int | None) -> pa.RecordBatch:
            nonlocal held, load
            codes = np.frombuffer(b"".join(h[4] for h in held), dtype=np.uint32)
            counts = np.array([h[3] for h in held])
            begins = np.cumsum(counts + size - 1) - (counts + size - 1)
            marked = _later_occurrences(codes, begins, counts, size)
            rows: list[tuple[int, int, int]] = []
            stay = []
            for h, b in zip(held, begins.tolist()):
                own = marked[b : b + h[3]]
                if not h[5] and own.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    rows.extend((h[1], h[2] + int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2]))
                if h[0] == keep_anchor and not own.all():
                    stay.append((*h[:5], True))
            held, load = stay, sum(h[3] for h in stay)
            return _marks(rows)

        lead: tuple | None = None
        for batch in batches:
            if "other" in batch.schema.names:
                windows = batch.filter(batch.column("other").is_valid())
                batch = batch.filter(batch.column("other").is_null())
                if windows.num_rows:
                    later, lead = _later_windows(windows, lead)
                    yield later
            done = batch.filter(batch.column("codes").is_null())
            if done.num_rows:
                yield done.select(["key", "first", "n"])
            rest = batch.filter(batch.column("codes").is_valid())
            for row in zip(*(rest.column(c).to_pylist() for c in ("anchor", "key", "first", "n", "codes"))):
                if held and load >= RUN_SUFFIXES:
                    # A run ends between two anchors, or inside a large one, whose earliest windows stay.
                    before = load
                    yield answer(row[0])
                    if load > before // 2:
                        load = 0 if not held else load - RUN_SUFFIXES  # distinct windows: let the run grow
                held.append((*row, False))
                load += row[3]
        if held:
            yield answer(None)

    return run


def _marks(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "first", "n"])


def _keyed(docs: DataFrame, keys: DataFrame | None) -> DataFrame:
    return with_row_key(docs.select("doc_id", "text"), keys).select(F.col("_key").alias("key"), "text")


def repeated_windows(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """key, first and n: runs of repeated windows by first word."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places, hot = _repeated_places(keyed.mapInArrow(_anchor_rows(size), _ANCHOR), RUN_SUFFIXES, "passage-places")
    segments = keyed.join(places.hint("shuffle_hash"), "key").mapInArrow(_segment_rows(size), _SEGMENT)
    order = ["anchor", "key", "first"]
    if not hot.isEmpty():
        segments = segments.join(broadcast_if_small(hot, MAX_BROADCAST_ANCHORS), "anchor", "left").mapInArrow(_hot_windows(size), _SEGMENT + ", other long")
        order.insert(1, "other")
    return segments.repartition(parts, "anchor").sortWithinPartitions(*order).mapInArrow(_tree_rows(size), "key long, first int, n int")


def _without(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _batches(batches):
            words = words_of(raw, offsets)
            marks = part.column("marks").fill_null([])
            owner = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy())
            runs = marks.flatten()
            first = words.first[owner] + runs.field("first").to_numpy(zero_copy_only=False)
            end = np.minimum(first + runs.field("n").to_numpy(zero_copy_only=False) + size - 1, words.first[owner + 1])
            cover = np.zeros(len(words.start) + 1, dtype=np.int64)
            valid = first < end
            np.add.at(cover, first[valid], 1)
            np.add.at(cover, end[valid], -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            data = raw.tobytes()
            starts, ends = words.start.tolist(), words.end.tolist()
            texts = []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                keep = np.flatnonzero(~gone[a:b]) + a
                texts.append(b" ".join([data[starts[i] : ends[i]] for i in keep.tolist()]))
            yield pa.record_batch(
                [part.column("key"), pa.array(np.diff(words.first), pa.int64()), pa.array(removed[words.first[1:]] - removed[words.first[:-1]], pa.int64()),
                 pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["key", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256 of every row."""
    keys = row_keys(docs)
    keyed = _keyed(docs, keys)
    marks = repeated_windows(keyed, size).groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("marks"))
    joined = keyed.join(marks.hint("shuffle_hash"), "key", "left")
    out = joined.mapInArrow(_without(size), "key long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return without_row_key(out, keys).select("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")
