"""Repeated byte strings by suffix arrays from external induced sorting.

A window is ``size`` consecutive bytes of one document; it is repeated if the same bytes start
anywhere else, in the same document or another.

1. Every window has an anchor, its 64-byte group with the smallest hash. Equal windows have
   equal anchors at equal places; a window whose anchor occurs once is not repeated. Anchors
   are about one byte in 170, and only they are shuffled.
2. Stretches of windows with one repeated anchor go on as segments, with their bytes. Equal
   segments of a batch are answered there and sent once, so no key is hot.
3. A task joins the segments of its anchors to one text, up to ``SHARD_BYTES`` at a time, and sorts
   its suffixes by external induction. Windows whose common prefix with a neighbour in the suffix
   array reaches ``size`` are repeated. Segments of an anchor that goes on stay for the next text.
   An anchor with more than ``SHARD_BYTES`` of distinct segments is hot: its windows go apart, each under its
   own hash, where sorted neighbours with 128 equal bits are equal, so no task holds a hot anchor's bytes.
4. Runs of repeated windows return to their documents.

The texts are shuffled once; the plan uses that shuffle twice.

Cases: null text counts as empty; texts below ``size`` bytes have no window; repeated rows are
documents of their own, so both lose what they share; null doc_id is an id like others, and one id may have several texts; texts of any
length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import _P, _RANDOM_BYTE, prefix, row_keys, row_slices, span_hash, string_buffer, without_row_key
from touchtally.llm.induced import suffix_array
from touchtally.llm.repeats import (
    HOT_SLICE, MAX_BROADCAST_ANCHORS, _ANCHOR, _first_of_equal, _keyed, _loads, _repeated_places, _spread, _window_runs, window_names,
)
from touchtally.sources.checkpoints import broadcast_if_small

SIZE = 400
ANCHOR = 64
SHARD_BYTES = 2 << 20


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        raw, offsets = string_buffer(batch.column("text"))
        for lo, hi in row_slices(offsets):
            yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def byte_anchors(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte of every window, its anchor's first byte, the hash of the group at every byte, and prefix sums."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    window = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    sums = prefix(_RANDOM_BYTE[raw], _P)
    if not len(window):
        return window, window, np.zeros(0, np.uint64), sums
    n = len(raw)
    at = np.arange(n - ANCHOR + 1)
    groups = span_hash(sums, at, at + ANCHOR, _P)
    bits = np.uint64(int(n).bit_length())
    low = (groups >> bits << bits) | at.astype(np.uint64)
    span, width = size - ANCHOR + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return window, (low[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), groups, sums


def _anchor_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _batches(batches):
            window, anchor, groups, sums = byte_anchors(raw, offsets, size)
            if not len(anchor):
                continue
            begin = np.flatnonzero(np.diff(anchor, prepend=-1))
            n = np.diff(np.append(begin, len(anchor))) + size - 1
            anchor, first = anchor[begin], window[begin]
            content = span_hash(sums, first, first + n, _P)
            key = groups[anchor]
            row = np.searchsorted(offsets, anchor, side="right") - 1
            ids, place = part.column("key").to_numpy()[row], anchor - offsets[row]
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


_SEGMENT = "anchor long, key long, first int, n int, data binary"


def _segment_rows(size: int):
    """Segments of repeated anchors; rows without data are marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _batches(batches):
            window, anchor, groups, sums = byte_anchors(raw, offsets, size)
            if not len(window):
                continue
            listed = part.column("places")
            owner = np.repeat(np.arange(part.num_rows), listed.value_lengths().to_numpy())
            repeated = np.zeros(len(raw), dtype=bool)
            places = offsets[owner] + listed.flatten().to_numpy()
            repeated[places[places < offsets[owner + 1]]] = True
            head = np.flatnonzero(np.diff(anchor, prepend=-1))
            n = np.diff(np.append(head, len(anchor)))
            wanted = repeated[anchor[head]]
            first, n, at = window[head[wanted]], n[wanted], anchor[head[wanted]]
            if not len(first):
                continue
            content = span_hash(sums, first, first + n + size - 1, _P)
            row = np.searchsorted(offsets, first, side="right") - 1
            ids, place = part.column("key").to_numpy()[row], first - offsets[row]
            order = np.lexsort((n, content))
            head, equal = _first_of_equal(order, content, n)
            send, done = order[head], order[equal]
            text = raw.tobytes()
            data = [text[a : a + k + size - 1] for a, k in zip(first[send].tolist(), n[send].tolist())]
            yield pa.record_batch(
                [pa.array(groups[at[send]].view(np.int64)), pa.array(ids[send]), pa.array(place[send], pa.int32()), pa.array(n[send], pa.int32()), pa.array(data, pa.binary())],
                names=["anchor", "key", "first", "n", "data"],
            )
            if len(done):
                yield pa.record_batch(
                    [pa.array(_spread(ids[done], place[done]).view(np.int64)), pa.array(ids[done]), pa.array(place[done], pa.int32()), pa.array(n[done], pa.int32()),
                     pa.nulls(len(done), pa.binary())],
                    names=["anchor", "key", "first", "n", "data"],
                )

    return run


def _hot_windows(size: int):
    """Windows of hot anchors, each a row under its own hash; other rows pass.

    ``other`` is the window's second hash. Equal windows of a batch are answered here, and
    one is sent, with n = 0.
    """

    def rows(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data = part.column("data")
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data.to_pylist()])])
        raw = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8)
        n = part.column("n").to_numpy()
        owner = np.repeat(np.arange(part.num_rows), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        name, other = window_names(_RANDOM_BYTE[raw], offsets[owner] + inside, size)
        ids, place = part.column("key").to_numpy()[owner], part.column("first").to_numpy()[owner] + inside
        order = np.lexsort((other, name))
        head, equal = _first_of_equal(order, name, other)
        done, send = np.zeros(len(order), dtype=bool), order[head]
        done[order[equal]] = True
        yield _window_rows(name[send], ids[send], place[send], np.where(done[send], 0, 1), other[send])
        at, k = _window_runs(done, owner)
        if len(at):
            yield _window_rows(_spread(ids[at], place[at]), ids[at], place[at], k, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column("hot").fill_null(False).to_numpy(zero_copy_only=False) & batch.column("data").is_valid().to_numpy(zero_copy_only=False)
            cold = batch.filter(pa.array(~hot)).select(["anchor", "key", "first", "n", "data"])
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
        names=["anchor", "key", "first", "n", "data", "other"],
    )


def _met_windows(rows: pa.RecordBatch, left: pa.RecordBatch | None) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Marks of windows with an equal beside them, and the last row, which may meet more; a row that is met has n = 2."""
    if left is not None:
        rows = pa.Table.from_batches([left, rows]).combine_chunks().to_batches()[0]
    name, other, n = (rows.column(c).to_numpy().copy() for c in ("anchor", "other", "n"))
    same = (name[1:] == name[:-1]) & (other[1:] == other[:-1])
    met = np.zeros(len(n), dtype=bool)
    met[1:] |= same
    met[:-1] |= same
    n[met & (n == 1)] = 2
    rows = rows.set_column(rows.schema.get_field_index("n"), "n", pa.array(n))
    return _met_marks(rows.slice(0, rows.num_rows - 1)), rows.slice(rows.num_rows - 1)


def _met_marks(rows: pa.RecordBatch) -> pa.RecordBatch:
    met = rows.filter(pa.array(rows.column("n").to_numpy() == 2))
    return pa.record_batch([met.column("key"), met.column("first"), pa.array(np.ones(met.num_rows), pa.int32())], names=["key", "first", "n"])


def repeated_starts(segments: list[bytes], several: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which starts of the joined text have a window that occurs twice, and where each segment begins.

    ``several`` says which segments stand for more than one place.
    """
    lengths = np.array([len(s) for s in segments])
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    text = np.zeros(int(lengths.sum()) + len(segments), dtype=np.uint16)
    inside = np.ones(len(text), dtype=bool)
    inside[begins + lengths] = False
    text[inside] = np.frombuffer(b"".join(segments), dtype=np.uint8).astype(np.uint16) + 1
    order, common = suffix_array(text, cap=size)
    windows = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(windows, begins, 1)
    np.add.at(windows, begins + lengths - size + 1, -1)
    is_window = np.cumsum(windows[:-1], out=windows[:-1]) > 0
    # Suffixes that are windows have ``size`` bytes before a separator, so equal prefixes are equal windows.
    deep = common >= size
    deep[1:] &= is_window[order[1:]] & is_window[order[:-1]]
    found = np.zeros(len(text), dtype=bool)
    found[order[deep]] = True
    found[order[np.flatnonzero(deep) - 1]] = True
    many = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(many, begins[several], 1)
    np.add.at(many, begins[several] + lengths[several], -1)
    return found | (is_window & (np.cumsum(many[:-1], out=many[:-1]) > 0)), begins


def _sorted_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, int, int, int]]] = {}  # places (anchor, id, first, n) of each distinct segment
        load = 0

        def answer(keep_anchor: int | None) -> pa.RecordBatch:
            nonlocal held, load
            segments = list(held)
            several = np.array([len(places) > 1 for places in held.values()])
            found, begins = repeated_starts(segments, several, size)
            rows: list[tuple[int, int, int]] = []
            stay: dict[bytes, list[tuple[int, int, int, int]]] = {}
            for segment, begin in zip(segments, begins.tolist()):
                places = held[segment]
                own = found[begin : begin + places[0][3]]
                if own.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    runs = [(int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2])]
                    rows.extend((p[1], p[2] + x, k) for p in places for x, k in runs)
                if places[0][0] == keep_anchor:
                    # One place stands for all in the next text; a marked one may be marked again.
                    stay[segment] = places[:1]
            held = stay
            load = sum(len(s) for s in stay)
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], names=["key", "first", "n"])

        limit = SHARD_BYTES
        left: pa.RecordBatch | None = None
        for batch in batches:
            if "other" in batch.schema.names:
                windows = batch.filter(batch.column("other").is_valid())
                batch = batch.filter(batch.column("other").is_null())
                if windows.num_rows:
                    met, left = _met_windows(windows, left)
                    yield met
            done = batch.filter(batch.column("data").is_null())
            if done.num_rows:
                yield done.select(["key", "first", "n"])
            rest = batch.filter(batch.column("data").is_valid())
            for anchor, key, first, n, data in zip(*(rest.column(c).to_pylist() for c in ("anchor", "key", "first", "n", "data"))):
                if held and load >= limit:
                    yield answer(anchor)
                    limit = max(SHARD_BYTES, 2 * load)
                places = held.setdefault(data, [])
                load += len(data) if not places else 0
                places.append((anchor, key, first, n))
        if left is not None:
            yield _met_marks(left)
        if held:
            yield answer(None)

    return run


def repeated_runs(keyed: DataFrame, size: int = SIZE) -> DataFrame:
    """key, first and n: runs of repeated windows by first byte."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places, hot = _repeated_places(keyed.mapInArrow(_anchor_rows(size), _ANCHOR), SHARD_BYTES, "byte-places")
    segments = keyed.join(places.hint("shuffle_hash"), "key").mapInArrow(_segment_rows(size), _SEGMENT)
    order = ["anchor"]
    if not hot.isEmpty():
        segments = segments.join(broadcast_if_small(hot, MAX_BROADCAST_ANCHORS), "anchor", "left").mapInArrow(_hot_windows(size), _SEGMENT + ", other long")
        order.append("other")
    return segments.repartition(parts, "anchor").sortWithinPartitions(*order).mapInArrow(_sorted_rows(size), "key long, first int, n int")


def _without(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in _batches(batches):
            marks = part.column("marks").fill_null([])
            owner = np.repeat(np.arange(part.num_rows), marks.value_lengths().to_numpy())
            runs = marks.flatten()
            first = offsets[owner] + runs.field("first").to_numpy(zero_copy_only=False)
            end = np.minimum(first + runs.field("n").to_numpy(zero_copy_only=False) + size - 1, offsets[owner + 1])
            cover = np.zeros(len(raw) + 1, dtype=np.int32)
            valid = first < end
            np.add.at(cover, first[valid], 1)
            np.add.at(cover, end[valid], -1)
            gone = np.cumsum(cover[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            starts = offsets[:-1][np.diff(offsets) > 0]
            opens[starts] = gone[starts]
            removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(opens)])
            kept = raw[~gone].tobytes()
            cuts = (offsets - removed[offsets]).tolist()
            yield pa.record_batch(
                [part.column("key"), pa.array(np.diff(offsets), pa.int64()), pa.array(np.diff(removed[offsets]), pa.int64()), pa.array(np.diff(spans[offsets]), pa.int64()),
                 pa.array([kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                 pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])], pa.string())],
                names=["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every row."""
    keys = row_keys(docs)
    keyed = _keyed(docs, keys)
    marks = repeated_runs(keyed, size).groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("marks"))
    joined = keyed.join(marks.hint("shuffle_hash"), "key", "left")
    out = joined.mapInArrow(_without(size), "key long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return without_row_key(out, keys).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
