"""A Merkle manifest of a dataset, with proofs for all rows by octopus multiproofs.

A row's leaf is the hash of its fields; a source's leaves in order of doc_id make a tree of runs
of three, the sources' roots in order of source make another, whose top is the manifest's root. H of
several inputs is the lower-case hex SHA-256 of the inputs one after the other, digests as hex text.

Leaves are hashed where the texts are scanned; only digests travel. Ranks come from a range sort by
source and doc_id, so a hot source is cut like any other. Leaves are then dealt to partitions of 3**HEIGHT consecutive ones of a
source (a row each, so memory is bounded), and trees grow a partition's height at a time.
For the proofs, each partition works out the coordinates of the nodes that its own leaves can't derive (the
union for all its leaves, each once), fetches them with one join, derives the shared interiors again, and
expands the proof of every leaf on the spot. Nodes above the leaf partitions are few: one for 3**HEIGHT leaves.

Cases: nulls are hashed as ``-``; a null source comes first and is a source; null ids come first in their source; rows
of one source and id are ordered by their leaves, and equal rows have proofs at different places; a lone leaf is
its source's root, a lone source's root the manifest's; an empty table has no rows. A null id is never tampered with.
Columns beside the five are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import written
from touchtally.sources.checkpoints import broadcast_if_small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
# Levels of a leaf partition: its row in the partition table holds 3**7 digests, some 200 kB.
HEIGHT = 7
MAX_BROADCAST_PARTITIONS = 4096


def hashed(*inputs: bytes) -> bytes:
    """H: hex digest of the inputs one after the other."""
    return hashlib.sha256(b"".join(inputs)).hexdigest().encode()


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of fields, ``-`` or byte count, colon and value for each, as binary."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tampered() -> Column:
    """Whether the row's text loses its line feeds."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def ranked(rows: DataFrame, tree: str, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with ``_rank`` (place in the order by tree and ``order``), and per tree its first rank and its count of rows.

    Both are written. A task's rows have consecutive ids, so only one count per task is added up.
    """
    sort = [tree, *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    placed = written(placed, name).withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n")).toArrow().sort_by("_part").to_pydict()
    before = dict(zip(counts["_part"], [0, *np.cumsum(counts["n"]).tolist()]))
    # One entry per task of the sort.
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "_part long, _before long"))
    placed = placed.join(starts, "_part").withColumn("_rank", F.col("_before") + F.col("_id").bitwiseAND(2**33 - 1)).drop("_id", "_part", "_before")
    trees = placed.groupBy(tree).agg(F.min("_rank").alias("first"), F.count("*").alias("leaves"))
    return placed, written(trees, f"{name}-trees")


def level_sizes(leaves: int) -> list[int]:
    """Nodes on each level, from the leaves to the root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def missing_nodes(positions: np.ndarray, sizes: Sequence[int], level: int = 0) -> list[tuple[int, int]]:
    """Octopus: the (level, position) that any set of nodes on one level can't derive, each once, bottom up.

    On each level the known nodes are those asked for or derived from below; their parents need all nodes of
    their runs, and what of those isn't known has to be fetched.
    """
    known, out = np.unique(np.asarray(positions, dtype=np.int64)), []
    for at in range(level, len(sizes) - 1):
        parents = np.unique(known // ARITY)
        runs = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        out += [(at, int(p)) for p in np.setdiff1d(runs[runs < sizes[at]], known)]
        known = parents
    return out


def grow(nodes: list[bytes], steps: int) -> list[list[bytes]]:
    """Levels above consecutive nodes whose first one starts a run: ``steps`` of them, the given one included."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([hashed(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _hexed(digests: pa.Array) -> list[bytes]:
    return [d.hex().encode() for d in digests.to_pylist()]


def _grown(partitions: DataFrame, base: int, inner: bool, height: int) -> DataFrame:
    """tree, leaves, level, position and hash of what partitions on level ``base`` derive: all levels (``inner``) or the top."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, (tree, part, leaves) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "leaves")))):
                steps = min(height, len(level_sizes(leaves)) - 1 - base)
                levels = grow(_hexed(batch.column("hashes")[i].values), steps)
                for step in range(1 if inner and steps else steps, steps + 1):
                    first = part * ARITY ** (height - step)
                    out += [(tree, leaves, base + step, first + j, bytes.fromhex(h.decode())) for j, h in enumerate(levels[step])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                ["tree", "leaves", "level", "position", "hash"],
            )

    return partitions.select("tree", "part", "leaves", "hashes").mapInArrow(derive, "tree long, leaves long, level int, position long, hash binary")


def _dealt(nodes: DataFrame, height: int, *carried: str) -> DataFrame:
    """A row per tree and 3**height consecutive positions: hashes and carried columns as arrays in order of position."""
    rows = F.array_sort(F.collect_list(F.struct("position", "hash", *carried)))
    dealt = nodes.groupBy("tree", "leaves", F.expr(f"position div {ARITY**height}").alias("part")).agg(rows.alias("rows"))
    return dealt.select("tree", "leaves", "part", *[F.col(f"rows.{c}").alias(name) for c, name in (("hash", "hashes"), *((c, c) for c in carried))])


def forest(partitions: DataFrame, name: str, inner: bool = False, height: int = HEIGHT) -> DataFrame:
    """Nodes above leaf partitions, (tree, leaves, level, position, hash), written; ``inner``: also those inside leaf partitions.

    Each round takes the tops of the last one, 3**height times fewer, so there are two or three.
    """
    made = written(_grown(partitions, 0, inner, height), f"{name}-0")
    nodes, base = made, height
    while True:
        open_trees = made.filter((F.col("level") == base) & (F.col("leaves") > ARITY**base))
        if open_trees.isEmpty():
            return nodes
        made = written(_grown(_dealt(open_trees, height), base, True, height), f"{name}-{base}")
        nodes, base = nodes.unionByName(made), base + height


def _tops(nodes: DataFrame) -> DataFrame:
    """The root of each tree: the only node of its highest level."""
    height = F.lit(0)
    for h in range(1, 41):
        height = F.when(F.col("leaves") > F.lit(ARITY ** (h - 1)), F.lit(h)).otherwise(height)
    return nodes.filter(F.col("level") == height)


def _requests(partitions: DataFrame, sources: int, height: int) -> DataFrame:
    """tree, part and the coordinates (in_tree, level, position) that the partition lacks; in_tree -1 is the tree of sources."""
    above, width = level_sizes(sources), ARITY**height

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tree, part, leaves in zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "leaves"))):
                own = np.arange(part * width, min((part + 1) * width, leaves))
                out += [(tree, part, tree, *at) for at in missing_nodes(own, level_sizes(leaves))]
                out += [(tree, part, -1, *at) for at in missing_nodes(np.array([tree]), above)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)], ["tree", "part", "in_tree", "level", "position"]
            )

    return partitions.select("tree", "part", "leaves").mapInArrow(ask, "tree long, part long, in_tree long, level int, position long")


class _Climb:
    """One partition's way up: its levels' nodes, then fetched nodes beside one derived node per level."""

    def __init__(self, nodes: list[bytes], first: int, sizes: Sequence[int], fetched: dict[tuple[int, int], bytes]):
        self.runs: list[tuple[int, list[bytes]]] = []  # per level: position of the first node, and the nodes of whole runs
        level, at = nodes, first
        for k in range(len(sizes) - 1):
            start = at // ARITY * ARITY
            end = min(-(-(at + len(level)) // ARITY) * ARITY, sizes[k])
            whole = [fetched[k, p] for p in range(start, at)] + level + [fetched[k, p] for p in range(at + len(level), end)]
            self.runs.append((start, whole))
            level, at = [hashed(*whole[i : i + ARITY]) for i in range(0, len(whole), ARITY)], start // ARITY
        self.root = level[0]

    def fold(self, position: int, node: bytes) -> bytes:
        """The root with ``node`` in place of the leaf at ``position``."""
        for start, whole in self.runs:
            i = (position - start) // ARITY * ARITY
            run = whole[i : i + ARITY]
            run[position - start - i] = node
            node, position = hashed(*run), position // ARITY
        return node

    def siblings(self, lowest: int, n: int, above: bytes) -> list[bytes]:
        """Of the n leaves from position ``lowest``: all siblings up to the root, then ``above``."""
        shared = {}  # of the level above, by position
        for k in range(len(self.runs) - 1, -1, -1):
            start, whole = self.runs[k]
            first, last = lowest // ARITY**k, (lowest + n - 1) // ARITY**k
            here = {}
            for p in range(first, last + 1):
                i = (p - start) // ARITY * ARITY
                run = whole[i : i + ARITY]
                del run[p - start - i]
                here[p] = b"".join(run) + shared.get(p // ARITY, above)
            shared = here
        return [shared[p] for p in range(lowest, lowest + n)] if self.runs else [above] * n


_RESULT = (
    "doc_id long, position long, tree long, leaf string, subroot string, root string, proof_sha256 string, "
    "tampered_leaf string, folded_root string, verified boolean"
)


def _expand(partitions: DataFrame, sources: int, root: bytes, height: int) -> DataFrame:
    above_sizes, width = level_sizes(sources), ARITY**height

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (tree, part, leaves, got) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tree", "part", "leaves", "got")))):
                fetched = {(g["in_tree"], g["level"], g["position"]): g["hash"].hex().encode() for g in got or ()}
                own, first = _hexed(batch.column("hashes")[i].values), part * width
                tree_climb = _Climb(own, first, level_sizes(leaves), {(k, p): h for (t, k, p), h in fetched.items() if t == tree})
                top_climb = _Climb([tree_climb.root], tree, above_sizes, {(k, p): h for (t, k, p), h in fetched.items() if t == -1})
                proofs = tree_climb.siblings(first, len(own), top_climb.siblings(tree, 1, b"")[0])
                folded, changed = [], []
                for j, other in enumerate(batch.column("other")[i].values.to_pylist()):
                    # An untouched leaf folds through the interiors that its partition has just derived.
                    changed.append(own[j] if other is None else other.hex().encode())
                    folded.append(top_climb.root if other is None else top_climb.fold(tree, tree_climb.fold(first + j, changed[-1])))
                n = len(own)

                def text(values: list[bytes]) -> pa.Array:
                    return pa.array(values, pa.binary()).cast(pa.string())

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i].values,
                        pa.array(np.arange(first, first + n)),
                        pa.array(np.full(n, tree)),
                        text(own),
                        text([tree_climb.root] * n),
                        text([root] * n),
                        text([hashed(p) for p in proofs]),
                        text(changed),
                        text(folded),
                        pa.array([f == root for f in folded], pa.bool_()),
                    ],
                    ["doc_id", "position", "tree", "leaf", "subroot", "root", "proof_sha256", "tampered_leaf", "folded_root", "verified"],
                )

    return partitions.mapInArrow(expand, _RESULT)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, position in its source, tree (rank of the source), leaf, subroot, root, proof_sha256, tampered_leaf, folded_root, verified."""
    spark = docs.sparkSession
    plain = [F.col(c) for c in FIELDS]
    without = [*plain[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    cut = tampered() & F.coalesce(F.contains(F.col("text"), F.lit("\n")), F.lit(False))
    leaves = docs.select(F.col("doc_id").cast("long"), "source", leaf(plain).alias("hash"), F.when(cut, leaf(without)).alias("other"))
    placed, sources = ranked(written(leaves, "manifest-leaves"), "source", ["doc_id", "hash", "other"], "manifest-ranked")
    listed, _ = ranked(sources.withColumn("top", F.lit(0)), "top", ["source"], "manifest-sources")
    listed = listed.withColumnRenamed("_rank", "tree").drop("top")
    count = listed.count()
    if not count:
        return spark.createDataFrame([], _RESULT)
    named = broadcast_if_small(listed.withColumnRenamed("source", "_source"), MAX_BROADCAST_PARTITIONS)
    nodes = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("position", F.col("_rank") - F.col("first"))
    partitions = written(_dealt(nodes.select("tree", "leaves", "position", "hash", "doc_id", "other"), height, "doc_id", "other"), "manifest-partitions")
    trees = forest(partitions, "manifest-nodes", height=height)
    subroots = _tops(trees).select(F.lit(-1).cast("long").alias("tree"), F.lit(count).cast("long").alias("leaves"), F.lit(0).alias("level"), F.col("tree").alias("position"), "hash")
    subroots = written(subroots, "manifest-subroots")
    above = forest(_dealt(subroots, height), "manifest-top", True, height).unionByName(subroots)
    root = _tops(above).first()["hash"].hex().encode()
    wanted = _requests(partitions, count, height).withColumnRenamed("tree", "for_tree")
    known = trees.unionByName(above).select(F.col("tree").alias("in_tree"), "level", "position", "hash")
    got = (
        wanted.join(known, ["in_tree", "level", "position"])
        .groupBy(F.col("for_tree").alias("tree"), "part")
        .agg(F.collect_list(F.struct("in_tree", "level", "position", "hash")).alias("got"))
    )
    got = broadcast_if_small(written(got, "manifest-fetched"), MAX_BROADCAST_PARTITIONS)
    return _expand(partitions.join(got, ["tree", "part"], "left"), count, root, height)
