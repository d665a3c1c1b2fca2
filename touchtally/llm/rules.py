"""Quality rules with a line sequence model.

A linear-chain conditional random field labels each line content or boilerplate.
It is trained with numpy on the lines of a bounded sample of labelled documents (lines
of low-quality documents as boilerplate) and decoded with Viterbi over all lines
of every text. A document is kept when content lines hold at least half of its
characters and the counted rules pass.

Cases: null and empty texts have no words and fail the base rules; texts are
read whole; without labelled rows every line is content; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm import spans
from touchtally.llm.common import _P, _RANDOM_BYTE, Words, prefix, row_slices, smallest_hashes, span_hash, string_buffer, words_of

# Bounds of the training sample: documents of each label, code points of each text, lines of each text.
TRAIN_DOCS = 600
# Lines of one training sequence; longer documents give several.
SEQUENCE_LINES = 48
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(spans.SYMBOLS)] = True


@dataclass
class Lines:
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first line of each row; one longer than the rows
    hash: np.ndarray
    n_words: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lines_of(raw: np.ndarray, offsets: np.ndarray, words: Words) -> Lines:
    """Lines between newlines; every row has one at least."""
    breaks = np.flatnonzero(raw == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    counts = np.bincount(row, minlength=len(offsets) - 1) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.empty(first[-1], dtype=np.int64)
    end = np.empty(first[-1], dtype=np.int64)
    start[first[:-1]], end[first[1:] - 1] = offsets[:-1], offsets[1:]
    inner = np.ones(first[-1], dtype=bool)
    inner[first[:-1]] = False
    start[inner] = breaks + 1
    inner = np.ones(first[-1], dtype=bool)
    inner[first[1:] - 1] = False
    end[inner] = breaks
    n_words = np.searchsorted(words.start, end) - np.searchsorted(words.start, start)
    return Lines(start, end, first, span_hash(prefix(_RANDOM_BYTE[raw], _P), start, end, _P), n_words)


def later_equal(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether an equal hash stands earlier in the same row."""
    order = np.lexsort((np.arange(len(row)), hashes, row))
    again = np.zeros(len(row), dtype=bool)
    again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    return again


def counts(raw: np.ndarray, offsets: np.ndarray, words: Words, lines: Lines) -> dict[str, np.ndarray]:
    """The counted rules of every row."""
    n = len(offsets) - 1
    inside = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(inside, words.start, 1)
    np.add.at(inside, words.end, -1)
    chars = np.concatenate([[0], np.cumsum((np.cumsum(inside[:-1]) > 0) & ((raw & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    filled = np.flatnonzero(lines.n_words > 0)
    repeated = filled[later_equal(lines.row[filled], lines.hash[filled])]
    at, window = words.windows(5)
    row = words.row[at]
    order = np.lexsort((window, row))
    same = (row[order[1:]] == row[order[:-1]]) & (window[order[1:]] == window[order[:-1]])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return {
        "n_words": np.diff(words.first),
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(lines.row[repeated], minlength=n),
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
    }


def features(raw: np.ndarray, lines: Lines, words: Words) -> np.ndarray:
    base = spans.describe(raw, lines.start, lines.end, words)
    row = lines.row
    place = np.arange(len(row))
    more = np.stack([later_equal(row, lines.hash), place == lines.first[row], place == lines.first[row + 1] - 1], axis=1)
    return np.concatenate([base, more.astype(np.float32)], axis=1)


@dataclass
class LineField:
    """Weights of the conditional random field over two labels."""

    emit: np.ndarray
    step: np.ndarray
    begin: np.ndarray

    def viterbi(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best label of every line; rows are decoded side by side, longest first."""
        gain = feats @ self.emit
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros(len(feats), dtype=np.int8)
        back = np.zeros((len(feats), 2), dtype=np.int8)
        best = self.begin + gain[first[:-1][order]]
        falling = -lengths[order]
        longest = int(lengths.max(initial=0))
        for t in range(1, longest):
            n = int(np.searchsorted(falling, -t))  # rows with more than t lines
            here = first[:-1][order[:n]] + t
            reach = best[:n, :, None] + self.step
            back[here] = reach.argmax(axis=1)
            best[:n] = reach.max(axis=1) + gain[here]
        label = best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            n = int(np.searchsorted(falling, -t))
            here = first[:-1][order[:n]] + t
            out[here] = label[:n]
            label[:n] = back[here, label[:n]]
        return out


def train(feats: list[np.ndarray], labels: list[int], rounds: int = 120) -> LineField:
    """Maximum likelihood by Adam; gradients from forward and backward sums over padded rows."""
    n, width = len(feats), feats[0].shape[1]
    longest = max(len(f) for f in feats)
    x = np.zeros((n, longest, width))
    here = np.zeros((n, longest), dtype=bool)
    for i, f in enumerate(feats):
        x[i, : len(f)], here[i, : len(f)] = f, True
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n), :, labels] = 1
    gold *= here[:, :, None]
    values = [np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])

    def fold(v, axis):
        top = v.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(v - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for turn in range(1, rounds + 1):
        emit, step, begin = values
        gain = x @ emit
        ahead, after = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = begin + gain[:, 0]
        for t in range(1, longest):
            new = fold(ahead[:, t - 1, :, None] + step, 1) + gain[:, t]
            ahead[:, t] = np.where(here[:, t, None], new, ahead[:, t - 1])
        total = fold(ahead[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = fold(step + (gain[:, t + 1] + after[:, t + 1])[:, None, :], 2)
            after[:, t] = np.where(here[:, t + 1, None], new, 0)
        share = np.exp(ahead + after - total[:, None, None]) * here[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + step + (gain + after)[:, 1:, None, :] - total[:, None, None, None]) * here[:, 1:, None, None]
        grads = [
            np.einsum("ntd,nts->ds", x, share - gold) / n + 1e-3 * emit,
            (pair.sum((0, 1)) - gold_step) / n + 1e-3 * step,
            (share[:, 0] - gold[:, 0]).sum(0) / n + 1e-3 * begin,
        ]
        for value, grad, m, v in zip(values, grads, first, second):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= 0.1 * m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return LineField(*values)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> tuple[list[str], list[int]]:
    """Bounded sample of labelled documents, ``per_label`` of each label by the smallest hashes, with their whole texts."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    chosen = {}
    for value in (0, 1):
        ids = smallest_hashes(known.filter(F.col(label) == value), F.xxhash64("doc_id", F.lit("sample")), per_label, "doc_id")
        chosen |= {r["doc_id"]: value for r in ids.select("doc_id").collect()}
    if not chosen:
        return [], []
    # An id may be repeated in the documents; one row of each is enough, so the sample stays bounded.
    rows = (
        docs.filter(F.col("doc_id").isin(list(chosen)) & F.col("text").isNotNull())
        .groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [chosen[r["doc_id"]] for r in rows]


def text_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return string_buffer(pa.array(texts, pa.large_string()))


def learn(docs: DataFrame, labels: DataFrame) -> LineField | None:
    texts, quality = labelled_sample(docs, labels, "quality", TRAIN_DOCS)
    if not texts:
        return None
    raw, offsets = text_arrays(texts)
    words = words_of(raw, offsets)
    lines = lines_of(raw, offsets, words)
    feats = features(raw, lines, words)
    parts, gold = [], []
    for a, b, good in zip(lines.first[:-1], lines.first[1:], quality):
        for at in range(a, b, SEQUENCE_LINES):
            parts.append(feats[at : min(b, at + SEQUENCE_LINES)])
            gold.append(CONTENT if good else BOILERPLATE)
    return train(parts, gold)


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, field: LineField | None) -> DataFrame:
    """Counts, content_share, base_failed and kept of every row, with doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                words = words_of(part, at)
                lines = lines_of(part, at, words)
                found = counts(part, at, words, lines)
                size = (lines.end - lines.start).astype(np.float64)
                content = size if field is None else size * (field.viterbi(features(part, lines, words), lines.first) == CONTENT)
                both = np.add.reduceat(np.stack([content, size]), lines.first[:-1], axis=1)
                share = both[0] / np.maximum(both[1], 1)
                failed = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
                yield pa.record_batch(
                    [batch.column("doc_id")[lo:hi], *[pa.array(found[k], pa.int64()) for k in _OUT], pa.array(share), pa.array(failed),
                     pa.array(~failed & (share >= CONTENT_SHARE))],
                    names=["doc_id", *_OUT, "content_share", "base_failed", "kept"],
                )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _OUT) + ", content_share double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
