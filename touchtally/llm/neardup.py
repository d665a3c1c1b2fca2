"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's word shingles are hashed once; the k smallest values are its sketch.
   Documents with equal shingle sets form a class, and only its smallest id goes on.
2. Inverted lists of the smallest ``LIST_VALUES`` retained values give candidates. A short list
   gives its pairs, and the union sketch (the k smallest of both sketches
   together) estimates their similarity; clear misses go. A long list, which a large group
   or a common passage makes, gives no pairs. Of two documents that are alike at the
   threshold, one with ``COLD_ENOUGH`` values in short lists shares one of those with
   probability 1 - 0.2**COLD_ENOUGH at least.
   Documents with fewer, and those that could be like one, take part in lists of their whole sketches,
   each with its rarest values only: as many that two sketches without one in common have an estimate
   that is a clear miss (prefix filter), so none is lost here. Documents that only share common passages
   have rarer values of their own, and don't meet. Short lists of these give pairs too; in a long one,
   each document is tied to the list's first.
3. Candidate clusters are the components of these ties. A cluster is cut into blocks. In
   a block's task all pairs not yet connected are estimated by their sketches, and confirmed by exact
   Jaccard similarity on whole sets; only confirmed links that connect something leave the task.
   Blocks share some of the cluster's members, so most of a large group is one component after
   that. Members outside the largest component are dealt to blocks of their own, and each of those
   meets every block of the cluster whose sets can be of like size: a task holds two blocks, however many such members there are.
4. Confirmed links give the result's components.

Cases: null text, and text without words, has an empty set and is linked with nothing; a text
shorter than a shingle is one shingle; repeated rows are one class; an empty table
gives an empty result. Ids are long and not null; rows with a null id get a null component and are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import SMALL_SLICE, Words, _Q, in_arrow, mix64, row_slices, span_hash, string_buffer, words_of, written
from touchtally.llm.components import components
from touchtally.sources.checkpoints import broadcast_if_small

SHINGLE = 5
PERCENT = 80
SKETCH = 64
LIST_VALUES = 16
COLD_ENOUGH = 10
# So many long lists of the smallest values make a document a possible partner of one with too few short lists.
PARTNER_HOT = 3
SHORT_LIST = 32
# Five standard deviations of the estimate below the threshold.
ESTIMATE_FLOOR = 0.55
BLOCK = 512
SHARED = 48


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending, and where each row's begin."""
    at, hashes = words.windows(n)
    per_row = np.diff(words.first)
    short = np.flatnonzero((per_row > 0) & (per_row < n))
    row = np.concatenate([words.row[at], short])
    hashes = np.concatenate([hashes, span_hash(words.sums, words.first[short], words.first[short + 1], _Q)])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(per_row) + 1))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = string_buffer(column)
    for lo, hi in row_slices(offsets, SMALL_SLICE):
        words = words_of(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
        yield (lo, hi, *shingle_sets(words, n))


def _lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    counts = ends - starts
    at = np.concatenate([[0], np.cumsum(counts)])
    flat = values[np.repeat(starts - at[:-1], counts) + np.arange(at[-1])] if at[-1] else values[:0]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the set's fingerprint) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, first in _sets(batch.column("text"), shingle):
                sums = np.concatenate([[0], np.cumsum(mix64(values + np.uint64(0x51ED270B)))]).astype(np.uint64)
                more = np.concatenate([[0], np.cumsum(mix64(values ^ np.uint64(0x7F4A7C159E3779B9)))]).astype(np.uint64)
                yield pa.record_batch(
                    [
                        batch.column("doc_id")[lo:hi],
                        pa.array(np.diff(first), pa.int64()),
                        pa.array((sums[first[1:]] - sums[first[:-1]]).view(np.int64)),
                        pa.array((more[first[1:]] - more[first[:-1]]).view(np.int64)),
                        _lists(values ^ np.uint64(1 << 63), first[:-1], np.minimum(first[:-1] + SKETCH, first[1:])),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "sketch"],
                )

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, k1 long, k2 long, sketch array<long>")


def _estimate(sketch, other):
    """Share of the union sketch that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(sketch, other)), 1, SKETCH)
    return F.size(F.array_intersect(union, F.array_intersect(sketch, other))) / F.size(union)


def rare_lists(classes: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """value, id, n and members: lists of partners by their rarest sketch values.

    Two sketches with an estimate of ``ESTIMATE_FLOOR`` share that part of the larger one at least. Where both sketches
    are whole sets, as those of sets of up to ``SKETCH * percent / 100`` and of all that can be like them are, it is ``percent``.
    A sketch of size s that must share c values shares one of its s - c + 1 rarest.
    """
    wide = written(
        classes.join(partners, "id").select("id", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value")), "wide"
    )
    sizes = wide.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    whole = F.col("n") <= SKETCH * percent // 100
    need = F.when(whole, F.floor((F.col("n") * percent + 99) / 100)).otherwise(F.ceil(F.col("size") * ESTIMATE_FLOOR - 1e-6))
    # Values without a list are the rarest of all, so they use up places.
    ranked = wide.join(sizes, "value").groupBy("id", "n", "size").agg(F.sort_array(F.collect_list(F.struct("members", "value"))).alias("ranked"))
    places = (F.size("ranked") - need + 1).cast("int")
    rarest = ranked.withColumn("places", places).filter("places > 0").select(
        "id", "n", F.explode(F.slice("ranked", F.lit(1), F.col("places"))).alias("entry")
    )
    rarest = written(rarest.select("id", "n", "entry.value"), "rarest")
    lists = rarest.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    return written(rarest.join(lists, "value"), "rare-lists")


def candidate_ties(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that may be alike: estimated pairs of short lists, stars of long ones."""
    entries = written(classes.select("id", "n", F.explode(F.slice("sketch", 1, LIST_VALUES)).alias("value")), "entries")
    sizes = entries.groupBy("value").agg(F.count("*").alias("members")).filter("members > 1")
    shared = written(entries.join(sizes, "value"), "shared")
    # Values with short lists, or only one member, are cold. A whole set may have few others.
    few_values = F.col("n") < LIST_VALUES
    hot = shared.filter(F.col("members") > SHORT_LIST).groupBy("id", "n").agg(F.count("*").alias("hot"))
    partners = hot.filter((F.col("hot") >= PARTNER_HOT) | few_values).select("id")
    rare = rare_lists(classes, partners, percent)

    def pairs(lists: DataFrame) -> DataFrame:
        cold = lists.filter(F.col("members") <= SHORT_LIST).select("value", "id", "n")
        other = cold.select("value", F.col("id").alias("id2"), F.col("n").alias("n2"))
        alike_size = (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("id") < F.col("id2"))
        return cold.join(other, "value").filter(alike_size).select("id", "id2")

    left = classes.select("id", "sketch")
    right = classes.select(F.col("id").alias("id2"), F.col("sketch").alias("sketch2"))
    met = pairs(shared).union(pairs(rare)).distinct()
    close = met.join(left, "id").join(right, "id2").filter(_estimate(F.col("sketch"), F.col("sketch2")) >= ESTIMATE_FLOOR)
    staying = rare.filter(F.col("members") > SHORT_LIST)
    heads = staying.groupBy("value").agg(F.min("id").alias("head"))
    stars = staying.join(heads, "value").select("id", F.col("head").alias("id2"))
    return close.select("id", "id2").union(stars).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


class _Forest:
    def __init__(self, labels: list[int]) -> None:
        seen: dict[int, int] = {}
        self.up = [seen.setdefault(label, i) for i, label in enumerate(labels)]

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """Sets as rows of packed bits over the values that two sets at least have."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    several = count[inverse] > 1
    width = -(-max(int((count > 1).sum()), 1) // 64)
    out = np.zeros((len(sets), width * 8), dtype=np.uint8)
    at = place[inverse[several]]
    np.bitwise_or.at(out, (owner[several], at >> 3), (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def block_links(ids: list[int], labels: list[int], side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join components not yet joined, among one block's members.

    Members of one side other than 0 are not compared with each other here: another task does that.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets])
    forest, links = _Forest(labels), []
    tops = [s[:SKETCH] for s in sets]
    in_sketch, whole = _bits(tops), _bits(sets)
    for lo in range(0, n - 1, 64):
        root = forest.roots()
        hi = min(lo + 64, n)
        a, b = np.nonzero(np.arange(lo, hi)[:, None] < np.arange(n)[None, :])
        a += lo
        ok = (root[a] != root[b]) & ~((side[a] == side[b]) & (side[a] > 0)) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        # The overlap of the sketches bounds the share of the union sketch from above.
        overlap = np.bitwise_count(in_sketch[a] & in_sketch[b]).sum(axis=1)
        full = np.minimum(SKETCH, np.maximum(size[a], size[b]))
        keep = overlap >= ESTIMATE_FLOOR * full
        a, b, overlap = a[keep], b[keep], overlap[keep]
        for i in np.argsort(-overlap, kind="stable").tolist():
            x, y = int(a[i]), int(b[i])
            if forest.find(x) == forest.find(y) or union_sketch(tops[x], tops[y]) < ESTIMATE_FLOOR:
                continue
            common = int(np.bitwise_count(whole[x] & whole[y]).sum())
            if 100 * common >= percent * (int(size[x]) + int(size[y]) - common):
                forest.join(x, y)
                links.append((ids[x], ids[y]))
    return links


def union_sketch(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated similarity: the share of the smallest values of both that both have."""
    both = np.sort(np.concatenate([x, y]))
    twice = np.flatnonzero(both[1:] == both[:-1])
    k = min(SKETCH, len(both) - len(twice))
    # The k-th distinct value: every value found twice before it pushes it one place on.
    rank = np.arange(len(twice))
    return float((twice - rank < k).sum()) / k


def confirm(members: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b); members are (id, block, label, side), a row for each block that an id takes part in."""
    tagged = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").join(
        broadcast_if_small(members), F.col("doc_id") == F.col("id")
    )
    # Repeated rows of an id: one is enough.
    need = tagged.select("id", "block", "label", "side", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, first in _sets(batch.column("text"), shingle):
                data = values.tobytes()
                cells = [data[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([*[batch.column(c)[lo:hi] for c in ("id", "block", "label", "side")], pa.array(cells, pa.binary())],
                                      names=["id", "block", "label", "side", "shingles"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                ids, labels, side, sets = zip(*held)
                out.extend(block_links(list(ids), list(labels), np.array(side), [np.frombuffer(s, dtype=np.uint64) for s in sets], percent))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "id", "label", "side", "shingles")]
            for block, i, label, side, data in zip(*columns):
                if block != current:
                    close()
                    current, held = block, []
                if not held or held[-1][0] != i:
                    held.append((i, label, side, data))
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        close()
        yield _pairs(out)

    sets = in_arrow(need, to_sets, "id long, block string, label long, side int, shingles binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(sets.repartition(parts, "block").sortWithinPartitions("block", "side", "id"), link, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])


def block_pairs(outside: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``confirm``: members in blocks (side 1) and outside ones in groups (side 2) of like size, once for each block and group that meet.

    Both have id, component, band and label. A block or a group is of one component and band.
    """
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))

    def dealt(rows: DataFrame, parts: str, part: str) -> tuple[DataFrame, DataFrame]:
        counts = rows.groupBy("component", "band").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).alias(parts))
        own = F.pmod(F.xxhash64("id", F.lit(part)), F.col(parts)).alias(part)
        return counts, rows.join(counts, ["component", "band"]).select("id", "component", "band", "label", own)

    def meeting(rows: DataFrame, counts: DataFrame, parts: str, part: str) -> DataFrame:
        others = counts.withColumnRenamed("band", "other")
        return rows.withColumn("other", near).join(others, ["component", "other"]).withColumn(
            part, F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
        )

    blocks, settled = dealt(members, "blocks", "block")
    groups, roaming = dealt(outside, "groups", "group")
    settled, roaming = meeting(settled, groups, "groups", "group"), meeting(roaming, blocks, "blocks", "block")
    return roaming.select("id", F.concat_ws("/", "component", "other", "block", "band", "group").alias("block"), "label", F.lit(2).alias("side")).union(
        settled.select("id", F.concat_ws("/", "component", "band", "block", "other", "group").alias("block"), "label", F.lit(1).alias("side"))
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    sketched = written(sketches(docs, shingle), "sketches")
    key = ["n_shingles", "k1", "k2"]
    classes = written(
        sketched.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*key).agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")).withColumnRenamed("n_shingles", "n"),
        "classes",
    )
    ties = candidate_ties(classes, percent)
    clusters = written(components(ties), "clusters")
    # Members are dealt to blocks by hash; about SHARED of a cluster's members are in all its blocks.
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    blocks = (F.floor((F.col("members") - 1) / BLOCK) + 1).alias("blocks")
    placed = written(
        clusters.join(sizes, "component").select(F.col("node").alias("id"), "component", blocks, "members")
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")))
        .withColumn("pivot", F.pmod(F.xxhash64("id", F.lit("pivot")), F.greatest(F.floor(F.col("members") / SHARED), F.lit(1))) == 0)
        .drop("members"),
        "blocks",
    )
    name = F.concat_ws("/", F.col("component"), F.col("block"))
    pivots = placed.filter(F.col("pivot") & (F.col("blocks") > 1)).select(
        "id", "component", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side")
    ).filter(F.col("block") != F.col("own")).drop("own")
    own = placed.select("id", "component", F.col("own").alias("block"), F.lit(0).alias("side"))
    first = own.union(pivots).select("id", name.alias("block"), F.col("id").alias("label"), "side")
    links = written(confirm(written(first, "members"), docs, shingle, percent), "confirmed")
    many = placed.filter("blocks > 1")
    if not many.isEmpty():
        after = components(links)
        # Sets that can be alike are of one band of sizes, or of two next to each other.
        band = F.floor(F.log("n") / (math.log(100 / percent) + 1e-6)).alias("band")
        labelled = many.join(after.withColumnRenamed("component", "label"), F.col("id") == F.col("node"), "left").join(
            classes.select("id", "n"), "id"
        ).select("id", "component", band, F.coalesce("label", "id").alias("label"))
        labelled = written(labelled, "labelled")
        counted = labelled.groupBy("component", "label").agg(F.count("*").alias("size"))
        main = counted.groupBy("component").agg(F.max(F.struct("size", "label")).getField("label").alias("main"))
        # Members outside the main component, in blocks of their own, meet the members of every block that can be like them.
        outside = labelled.join(main, "component").filter(F.col("label") != F.col("main")).drop("main")
        second = block_pairs(written(outside, "outside"), labelled)
        links = links.union(confirm(written(second, "members"), docs, shingle, percent))
    found = written(components(links), "components").join(classes.withColumnRenamed("id", "node"), "node").select(
        F.col("n").alias("n_shingles"), "k1", "k2", "component"
    )
    named = classes.select(F.col("n").alias("n_shingles"), "k1", "k2", "id").join(found, key, "left").select(
        *key, F.coalesce("component", "id").alias("_component")
    )
    out = sketched.drop("sketch").join(named, key, "left")
    return out.withColumn("component_id", F.coalesce("_component", "doc_id")).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
