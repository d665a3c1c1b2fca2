"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over windows of fixed length, the
largest response of each filter over a window goes to a softmax. The network is trained
with numpy on a bounded sample of labelled windows and applied to every window of every
text; a document's distribution is the geometric mean of its windows', weighted by length.

Cases: null texts and texts without a letter are ``und`` with score 0, and so are all
texts when no labelled row exists; short windows are padded with zero bytes; repeated rows get
equal results; labels that are null are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.llm.common import in_arrow, row_slices, string_buffer

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
# Bound of the sample that the network is trained on: windows, at most one per document.
TRAIN_WINDOWS = 4000
# With many labels, at least so many of each.
MIN_WINDOWS = 50
EPOCHS = 5
BLOCK = 128
UNKNOWN = "und"


def fold(key: str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def window_sample(labelled: DataFrame, label: str, size: int = TRAIN_WINDOWS) -> tuple[list[str], list[bytes]]:
    """About ``size`` labels and windows, as many of each label: the rows with its smallest hashes, one hashed window of each row's text.

    Labels with fewer rows give all of them, so that a rare one is learned too.
    """
    at = 1 + F.pmod(F.xxhash64(F.col("doc_id"), F.lit("place")), F.greatest(F.length("text") - WINDOW // 2, F.lit(1)))
    known = labelled.filter(F.col(label).isNotNull() & (F.length("text") > 0)).select(
        "doc_id", F.col(label).alias("label"), F.substring(F.col("text"), at.cast("int"), F.lit(WINDOW)).alias("window")
    )
    counts = {r["label"]: r["count"] for r in labelled.filter(F.col(label).isNotNull() & (F.length("text") > 0)).groupBy(F.col(label).alias("label")).count().collect()}
    if not counts:
        return [], []
    per = max(MIN_WINDOWS, size // len(counts))
    # Counts bound the hash first, so tasks send a few times the sample. Ties are ordered by the rest of the row, so reruns agree.
    bound = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 4 * per / n))])
    draw = F.xxhash64("doc_id", "window", F.lit("draw"))
    few = known.withColumn("draw", draw).filter(F.col("draw") / F.lit(2.0**64) + 0.5 <= F.try_element_at(bound, F.col("label")))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "window"))
    rows = few.withColumn("place", place).filter(F.col("place") <= per).orderBy("label", "place").collect()
    return [r["label"] for r in rows], [r["window"].encode()[:WINDOW] for r in rows]


@dataclass
class ByteConvNet:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # max(WIDTHS) * EMBED x all filters; zero below a narrow filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        n, length = windows.shape
        widest = max(WIDTHS)
        padded = np.zeros((n, length + widest - 1), dtype=np.uint8)
        padded[:, :length] = windows
        embedded = self.embed[padded]
        patches = np.empty((n, length, widest, EMBED), dtype=np.float32)
        for k in range(widest):
            patches[:, :, k] = embedded[:, k : k + length]
        return patches.reshape(n, length, widest * EMBED)

    def pooled(self, patches: np.ndarray) -> np.ndarray:
        """Filter responses; the largest per window is taken by the callers."""
        n, length, size = patches.shape
        return (patches.reshape(-1, size) @ self.filters).reshape(n, length, -1)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.pooled(self._patches(windows)).max(axis=1) + self.bias, 0)
        return _log_softmax(hidden @ self.out + self.out_bias)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def as_windows(texts: list[bytes], length: int = WINDOW) -> np.ndarray:
    out = np.zeros((len(texts), length), dtype=np.uint8)
    for row, text in zip(out, texts):
        row[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


def train(labels: list[str], texts: list[bytes], epochs: int = EPOCHS, seed: int = 7, batch: int = 64) -> ByteConvNet | None:
    """Adam on cross entropy; part of the windows is shortened in each epoch, for short texts."""
    if not labels:
        return None
    names = sorted(set(labels))
    target = np.searchsorted(names, labels)
    windows = as_windows(texts)
    sizes = np.array([len(t) for t in texts])
    rng = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat(np.arange(widest) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
    net = ByteConvNet(
        names,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, (widest * EMBED, n_filters)) * mask).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.2, (n_filters, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    values = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(target))
        cut = np.where(rng.random(len(target)) < 0.5, sizes, np.maximum((sizes * rng.random(len(target)) ** 2).astype(int), np.minimum(sizes, 12)))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            x = np.where(np.arange(WINDOW)[None, :] < cut[pick][:, None], windows[pick], 0).astype(np.uint8)
            patches = net._patches(x)
            response = net.pooled(patches)
            at = response.argmax(axis=1)
            rows = np.arange(len(pick))[:, None]
            top = response[rows, at, np.arange(n_filters)] + net.bias
            hidden = np.maximum(top, 0)
            error = np.exp(_log_softmax(hidden @ net.out + net.out_bias))
            error[np.arange(len(pick)), target[pick]] -= 1
            error /= len(pick)
            back = (error @ net.out.T) * (top > 0)
            best = patches[rows, at]  # rows x filters x patch: only the pooled place gets a gradient
            to_patch = back[:, :, None] * net.filters.T[None]
            padded = np.zeros((len(pick), WINDOW + widest - 1), dtype=np.uint8)
            padded[:, :WINDOW] = x
            d_embed = np.zeros_like(net.embed)
            for k in range(widest):
                np.add.at(d_embed, padded[rows, at + k], to_patch[:, :, k * EMBED : (k + 1) * EMBED])
            grads = [d_embed, np.einsum("bf,bfp->pf", back, best) * mask, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for value, grad, m, v in zip(values, grads, first, second):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= (0.01 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and size of every window of every row."""
    counts = -(-np.diff(offsets) // WINDOW)
    row = np.repeat(np.arange(len(counts)), counts)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    return row, start, np.minimum(offsets[row + 1] - start, WINDOW)


def document_distributions(net: ByteConvNet, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each label, a row for each text; empty texts have none."""
    row, start, size = _windows_of(raw, offsets)
    total = np.zeros((len(offsets) - 1, len(net.labels)))
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    for lo in range(0, len(row), BLOCK):
        x = views[start[lo : lo + BLOCK]].copy()
        short = np.flatnonzero(size[lo : lo + BLOCK] < WINDOW)
        for i in short:
            x[i, size[lo + i] :] = 0
        weighed = net.log_probabilities(x) * size[lo : lo + BLOCK, None]
        np.add.at(total, row[lo : lo + BLOCK], weighed)
    return np.exp(_log_softmax(total / np.maximum(np.diff(offsets), 1)[:, None]))


def identify(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """docs with lang_pred and score."""
    named = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if net is None:
        return docs.select(*named, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*net.labels, UNKNOWN])
        for batch in batches:
            raw, offsets = string_buffer(batch.column("text"))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in row_slices(offsets):
                share = document_distributions(net, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                known = letters[lo:hi]
                best = np.where(known, share.argmax(axis=1), len(net.labels))
                score = np.where(known, share.max(axis=1), 0.0)
                columns = [batch.column(c)[lo:hi] for c in named]
                yield pa.record_batch([*columns, names.take(pa.array(best)), pa.array(score)], names=[*named, "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = docs.select(*named, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return in_arrow(docs.select(*named, has_letter.alias("_letters")), run, schema)


def learn(docs: DataFrame, label: str = "lang", size: int = TRAIN_WINDOWS) -> ByteConvNet | None:
    """Train on rows outside the held-out fold (crc32 of doc_id modulo 4 equal to 2)."""
    return train(*window_sample(docs.filter(fold("doc_id", 4) != 2), label, size))
