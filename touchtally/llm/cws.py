"""Document fingerprints by consistent weighted sampling.

A document is a bag of words weighted by their counts. For each of K samples every
word draws r, c from Gamma(2, 1) and b uniform, from hashes of the word alone, and
with weight w gets

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r.

The word with the smallest a is the sample, and (word, t) its value. Two documents
agree in one sample with probability sum(min(w, w')) / sum(max(w, w')), the
generalised Jaccard similarity.

Cases: null and empty texts, and texts without words, share one fingerprint of
zeros, which agrees with itself only. Repeated rows get equal fingerprints. Texts of any
length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import BATCH_BYTES, mix64, row_slices, string_buffer, words_of

SAMPLES = 64
# Entries (document, word) whose samples are held at once.
ENTRY_BLOCK = 1 << 13
SLICES_PER_PARTITION = 8


@lru_cache(maxsize=1)
def _gamma_two() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 0.5) / 2**16: the inverse of 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.linspace(0, 0.05, 20001)[1:], np.linspace(0.05, 30, 400001)[1:]])
    return np.interp((np.arange(65536) + 0.5) / 65536, -np.expm1(-x) - x * np.exp(-x), x).astype(np.float32)


def _draws(words: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each word and sample."""
    seeds = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    one = mix64(words[:, None] ^ seeds[None, :])
    two = mix64(one + np.uint64(0x2545F4914F6CDD1D))
    low = np.uint64(0xFFFFFFFF)
    scale = np.float32(2.0**-32)
    u = ((one >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * scale
    v = ((one & low).astype(np.float32) + np.float32(0.5)) * scale
    # Products of two numbers just below 1 may round to 1; c must stay positive.
    log_c = np.log(np.maximum(-np.log(u * v), np.float32(1e-7)))
    r = _gamma_two()[(two >> np.uint64(48)).astype(np.int64)]
    b = ((two & low).astype(np.float32)) * scale
    return r, log_c, b


def _packed(log_a: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(log_a, code) as one integer that sorts by log_a."""
    bits = np.ascontiguousarray(log_a, dtype=np.float32).view(np.int32)
    rising = np.where(bits < 0, ~bits, bits ^ np.int32(-(2**31))).view(np.uint32)
    return (rising.astype(np.uint64) << np.uint64(32)) | codes


def _codes(words: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (mix64(words ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))) >> np.uint64(32)) | np.uint64(1)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 32-bit values for each text in the buffer."""
    found = words_of(raw, offsets)
    n_rows = len(offsets) - 1
    out = np.zeros((n_rows, samples), dtype=np.uint32)
    if not len(found.hash):
        return out
    vocabulary, term = np.unique(found.hash, return_inverse=True)
    pair, count = np.unique(found.row * len(vocabulary) + term, return_counts=True)
    row, term = np.divmod(pair, len(vocabulary))
    single = np.empty((len(vocabulary), samples), dtype=np.uint64)
    for lo in range(0, len(vocabulary), ENTRY_BLOCK):
        words = vocabulary[lo : lo + ENTRY_BLOCK]
        r, log_c, b = _draws(words, samples)
        single[lo : lo + ENTRY_BLOCK] = _packed(log_c + r * b - r, _codes(words, np.zeros(len(words)))[:, None])
    best = np.full((n_rows, samples), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(pair), ENTRY_BLOCK):
        rows, terms, weights = row[lo : lo + ENTRY_BLOCK], term[lo : lo + ENTRY_BLOCK], count[lo : lo + ENTRY_BLOCK]
        value = single[terms]
        more = np.flatnonzero(weights > 1)
        if len(more):
            words = vocabulary[terms[more]]
            r, log_c, b = _draws(words, samples)
            t = np.floor(np.log(weights[more]).astype(np.float32)[:, None] / r + b)
            value[more] = _packed(log_c - r * (t - b) - r, _codes(words[:, None], t))
        heads = np.flatnonzero(np.diff(rows, prepend=-1))
        at = rows[heads]
        best[at] = np.minimum(best[at], np.minimum.reduceat(value, heads, axis=0))
    filled = np.diff(found.first) > 0
    out[filled] = (best[filled] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples; the estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def _hex(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in np.ascontiguousarray(values.astype(">u4"))], pa.string())


def fingerprint_column(samples: int = SAMPLES):
    """A map over Arrow batches (doc_id, text) that adds ``fingerprint``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets):
                prints = fingerprints(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], samples)
                yield pa.record_batch([batch.column("doc_id")[lo:hi], _hex(prints)], names=["doc_id", "fingerprint"])

    return run


def document_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every row."""
    return docs.select("doc_id", "text").mapInArrow(fingerprint_column(samples), "doc_id long, fingerprint string")


def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by binary search."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*[F.lit(b) for b in bounds]), F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= value), at + step).otherwise(at),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Every row beside its successor by doc_id, as a sorted stream.

    Rows are cut into ranges of doc_id. The first row of a range is sent a second
    time, as ``closing``, to the range before, so each range holds its last row's
    successor; the first of all closes the last range. Ranges are dealt to tasks and
    sorted there: one shuffle, no global window. Order is doc_id (null first), then text.
    """
    lowest = -(2**63)
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(lowest)).alias("key"), "doc_id", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = parts * SLICES_PER_PARTITION
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    bounds = sorted({int(x) for x in cuts})
    placed = keyed.withColumn("slice", _position(F.col("key"), bounds))
    # One row per slice: bounded by the number of slices, not by the table.
    heads = {r["slice"]: r["head"] for r in placed.groupBy("slice").agg(F.min("key").alias("head")).collect()}
    used = sorted(heads)
    head = [heads.get(i, 0) for i in range(len(bounds) + 1)]
    before = [0] * (len(bounds) + 1)
    for i, at in enumerate(used):
        before[at] = used[i - 1]
    head_of = F.get(F.array(*[F.lit(h) for h in head]), F.col("slice"))
    before_of = F.get(F.array(*[F.lit(b) for b in before]), F.col("slice"))
    own = F.struct(F.col("slice").alias("to"), F.lit(0).alias("closing"))
    sent = F.when(F.col("key") == head_of, F.array(own, F.struct(before_of.alias("to"), F.lit(1).alias("closing")))).otherwise(F.array(own))
    return (
        placed.select("key", "doc_id", "text", F.explode(sent).alias("at"))
        .select(F.col("at.to").alias("slice"), F.col("at.closing").alias("closing"), "key", "doc_id", "text")
        .repartition(parts, "slice").sortWithinPartitions("slice", "closing", "key", "text")
    )


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited_rows(samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            _, offsets = string_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets, BATCH_BYTES // 2):
                part = batch.slice(lo, hi - lo)
                if rest is not None:
                    part = pa.Table.from_batches([rest, part]).combine_chunks().to_batches()[0]
                yield from _edited_batch(part, samples)
                rest = part.slice(part.num_rows - 1)

    return run


def _edited_batch(part: pa.RecordBatch, samples: int) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last, which waits for its successor."""
    slices, closing = part.column("slice").to_numpy(), part.column("closing").to_numpy()
    own = np.flatnonzero((closing[:-1] == 0) & (slices[:-1] == slices[1:]))
    if not len(own):
        return
    column = part.column("text").fill_null("")
    texts = column.to_pylist()
    edited, lengths = [], []
    for i in own:
        text = texts[i]
        half = len(text) // 2
        edited.append(text[: len(text) - half] + texts[i + 1][:half])
        lengths.append(len(text))
    edited_column = pa.array(edited, pa.large_string())
    raw, offsets = string_buffer(pa.concat_arrays([column.cast(pa.large_string()), edited_column]))
    prints = fingerprints(raw, offsets, samples)
    base, changed = prints[own], prints[len(texts) :]
    yield pa.record_batch(
        [
            part.column("doc_id").take(pa.array(own)),
            pa.array(lengths, pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _hex(base),
            _hex(changed),
            pa.array(likeness(base, changed)),
            pa.array(likeness(base, prints[own + 1])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or
    all) of the next document's.
    """
    return with_next(docs.select("doc_id", "text")).mapInArrow(_edited_rows(samples), _EDITED)
