"""What the corpus operators share: reading documents, written intermediates, word arrays.

Word arrays work on the UTF-8 buffer of an Arrow column: no Python object is made
per document or word. Hashes are polynomial prefix sums over random byte values, so any span's hash is
two look-ups. There are two sums, modulo the prime 2**31 - 1 and with bases of their own: modulo a power of two
some texts would have one hash whatever the base is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.sources.checkpoints import _ensure_folder

# A word, as all contracts on word counts state it.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 1 << 20
# For steps whose arrays are a hundred times their slice.
SMALL_SLICE = 1 << 18
# Of one Arrow batch, where the session sets no limit of its own: 10,000 long texts would be up to 64 MB in a worker and in the JVM.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
# Stands for a null doc_id in keys; it comes first.
NO_ID = -(2**63)

# Lists of tables that open blocks of last_table_only have written.
_OPEN: list[list[str]] = []
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_RANDOM_BYTE = np.random.default_rng(20260601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` on batches of about ``ARROW_BYTES``. The limit stays set in the session, since the plan runs later."""
    conf = df.sparkSession.conf
    if conf.get(_ARROW_LIMIT, None) is None:
        conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own, not made yet, in the shared checkpoint folder."""
    _ensure_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like a checkpoint, but keeps columns compressed and prunable, and
    survives lost executors.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    for tables in _OPEN:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def last_table_only(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside, but for the last one, when the block ends well.

    What the block gives back may read that last table only, or tables from before it.
    """
    tables: list[str] = []
    _OPEN.append(tables)
    try:
        yield
    finally:
        _OPEN[:] = [other for other in _OPEN if other is not tables]
    for path in tables[:-1]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _row_name(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_twin", F.xxhash64(F.coalesce("text", F.lit(""))))


def row_keys(docs: DataFrame) -> DataFrame | None:
    """A key for each doc_id and text, in order of doc_id, if one doc_id (null too) has several texts; else None."""
    named = _row_name(docs.select("doc_id", "text")).select("_doc", "_twin")
    several = named.groupBy("_doc").agg(F.min("_twin").alias("low"), F.max("_twin").alias("high")).filter("low <> high")
    if several.isEmpty():
        return None
    return written(named.distinct().orderBy("_doc", "_twin").withColumn("_key", F.monotonically_increasing_id()), "row-keys")


def with_row_key(docs: DataFrame, keys: DataFrame | None) -> DataFrame:
    """docs with ``_key``: the row's key, or the doc_id (null as the smallest long) where that names one text."""
    if keys is None:
        return docs.withColumn("_key", F.coalesce("doc_id", F.lit(NO_ID)))
    return _row_name(docs).join(keys, ["_doc", "_twin"]).drop("_doc", "_twin")


def without_row_key(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """rows with the doc_id of their ``key``."""
    if keys is not None:
        rows = rows.join(keys.select(F.col("_key").alias("key"), "_doc"), "key").withColumn("key", F.col("_doc")).drop("_doc")
    return rows.withColumn("doc_id", F.nullif("key", F.lit(NO_ID)))


def word_count(text="text"):
    """Words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def smallest_hashes(df: DataFrame, draw, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest 64-bit hash ``draw``.

    A count bounds the hash first, so that all tasks together send a few times ``n`` rows, not ``n`` each.
    """
    total = df.count()
    if total > 4 * n:
        df = df.filter(draw <= F.lit(-(2**63) + 2**64 * 4 * n // total))
    return df.withColumn("_draw", draw).orderBy("_draw", *ties).limit(n).drop("_draw")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_PRIME = (1 << 31) - 1
_MASK, _SHIFT = np.uint64(_PRIME), np.uint64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, up to the prime itself and a little more, for x below 2**63; in place."""
    high = x >> _SHIFT
    x &= _MASK
    x += high
    return x


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2**63; in place."""
    x = _reduced(_reduced(x))
    x[x >= _MASK] -= _MASK
    return x


# The longest run of powers asked for of each base.
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo the prime for i < n, a power of two, by doubling."""
    out = np.ones(n, dtype=np.uint32)
    done = 1
    while done < n:
        out[done : 2 * done] = _residue(out[:done] * np.uint64(pow(base, done, _PRIME)))
        done *= 2
    return out


def _lanes(base: int) -> tuple[int, int]:
    return base % _PRIME, (base >> 32) % _PRIME


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i < n, four bytes each; sizes are rounded up, and one run per base is kept, so that a worker holds few."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = _POWERS[base] = _powers(base, 1 << max(12, int(n - 1).bit_length()))
    return known[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i in two lanes, one longer than ``values``; the lanes take 31 bits of a value each."""
    out = np.zeros((2, len(values) + 1), dtype=np.uint64)
    for lane, b in enumerate(_lanes(base)):
        x = values >> np.uint64(31 * lane)
        x &= _MASK
        x *= powers(b, len(values))
        # Below 2**33 each, so up to 2**30 of them add up exactly.
        np.cumsum(_reduced(x), out=out[lane, 1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Position-free hash of the spans [start, end) of the values behind ``sums``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(starts), dtype=np.uint64)
    for lane, b in enumerate(_lanes(base)):
        x = _residue(sums[lane][ends] - sums[lane][starts])
        x *= powers(pow(b, -1, _PRIME), sums.shape[1])[starts]
        out |= _residue(x) << np.uint64(31 * lane)
    return mix64(out)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``limit`` bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a run of rows: byte spans, hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one longer than the rows
    sums: np.ndarray  # prefix sums over word hashes

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every n-word window inside one row."""
        counts = np.maximum(np.diff(self.first) - n + 1, 0)
        at = np.repeat(self.first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return at, span_hash(self.sums, at, at + n, _Q)


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows whose bytes are ``raw[offsets[i]:offsets[i + 1]]``; ``offsets[0]`` must be 0."""
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    before, after = np.zeros(len(raw), dtype=bool), np.zeros(len(raw), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cuts], after[cuts - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    hashes = span_hash(prefix(_RANDOM_BYTE[raw], _P), start, end, _P)
    return Words(start, end, hashes, np.searchsorted(start, offsets), prefix(hashes, _Q))
