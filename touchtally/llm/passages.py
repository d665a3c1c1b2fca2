"""Quality score by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded from the mean of learned
word vectors (words hashed into a table) and from counts that describe it. Gated
attention weighs the passages, and the weighted sum of encodings gives the score. All
weights are learned with numpy from labels of whole documents.

Cases: null and empty texts are one empty passage; texts are read whole; repeated rows get
equal scores; without labelled rows every score is 0.5; labels other than 0 and 1 are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm import spans
from touchtally.llm.common import Words, row_slices, string_buffer, words_of
from touchtally.llm.language import fold
from touchtally.llm.rules import labelled_sample, text_arrays

PASSAGE = 64
TABLE_BITS = 12
VECTOR = 12
HIDDEN = 24
ATTEND = 12
# Bounds of the training sample: documents of each label, code points of each text.
TRAIN_DOCS = 900
EPOCHS = 12
THRESHOLD = 0.3


@dataclass
class Bags:
    """Passages of a run of texts."""

    stats: np.ndarray  # passages x features
    word: np.ndarray  # table cell of each word
    word_first: np.ndarray  # first word of each passage; one longer than the passages
    first: np.ndarray  # first passage of each text; one longer than the texts


def bags_of(raw: np.ndarray, offsets: np.ndarray, words: Words) -> Bags:
    n_words = np.diff(words.first)
    counts = np.maximum(-(-n_words // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    turn = np.arange(len(row)) - first[row]
    word_first = np.append(words.first[row] + np.minimum(turn * PASSAGE, n_words[row]), words.first[-1])
    bounds = np.append(words.start, len(raw))
    start = bounds[word_first[:-1]]
    start[first[:-1]] = offsets[:-1]
    end = np.append(start[1:], len(raw))
    return Bags(spans.describe(raw, start, end, words), (words.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int64), word_first, first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1]); empty ranges give 0."""
    out = np.zeros((len(first) - 1, values.shape[1]), dtype=values.dtype)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, first[:-1][filled], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionScorer:
    """Parameters: word table, encoder, gated attention (value and gate), output."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        width = VECTOR + len(spans.NAMES)

        def draw(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.values = {
            "table": (rng.normal(0, 0.1, (1 << TABLE_BITS, VECTOR))).astype(np.float32),
            "encode": draw(width, HIDDEN), "encode_bias": np.zeros(HIDDEN, np.float32),
            "value": draw(HIDDEN, ATTEND), "gate": draw(HIDDEN, ATTEND), "pick": draw(ATTEND, 1),
            "out": draw(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, b: Bags) -> dict[str, np.ndarray]:
        v = self.values
        n_words = np.maximum(np.diff(b.word_first), 1)[:, None].astype(np.float32)
        vectors = _sums(v["table"][b.word], b.word_first) / n_words
        x = np.concatenate([vectors, b.stats], axis=1)
        h = np.tanh(x @ v["encode"] + v["encode_bias"])
        value, gate = np.tanh(h @ v["value"]), _sigmoid(h @ v["gate"])
        logit = ((value * gate) @ v["pick"])[:, 0]
        bag = np.repeat(np.arange(len(b.first) - 1), np.diff(b.first))
        weight = np.exp(logit - np.maximum.reduceat(logit, b.first[:-1])[bag])
        weight /= np.add.reduceat(weight, b.first[:-1])[bag]
        z = np.add.reduceat(h * weight[:, None], b.first[:-1], axis=0)
        score = _sigmoid(z @ v["out"] + v["out_bias"])[:, 0]
        return {"n_words": n_words, "x": x, "h": h, "value": value, "gate": gate, "bag": bag, "weight": weight, "z": z, "score": score}

    def gradients(self, b: Bags, f: dict[str, np.ndarray], target: np.ndarray) -> dict[str, np.ndarray]:
        v, bag, weight, h = self.values, f["bag"], f["weight"][:, None], f["h"]
        error = ((f["score"] - target) / len(target))[:, None].astype(np.float32)
        d_z = error @ v["out"].T
        d_weight = (d_z[bag] * h).sum(axis=1, keepdims=True)
        mean = np.add.reduceat(weight * d_weight, b.first[:-1], axis=0)[bag]
        d_logit = weight * (d_weight - mean)
        both = d_logit @ v["pick"].T
        d_value, d_gate = both * f["gate"] * (1 - f["value"] ** 2), both * f["value"] * f["gate"] * (1 - f["gate"])
        d_h = d_z[bag] * weight + d_value @ v["value"].T + d_gate @ v["gate"].T
        d_pre = d_h * (1 - h**2)
        d_vector = (d_pre @ v["encode"].T)[:, :VECTOR] / f["n_words"]
        d_table = np.zeros_like(v["table"])
        np.add.at(d_table, b.word, np.repeat(d_vector, np.diff(b.word_first), axis=0))
        return {
            "table": d_table, "encode": f["x"].T @ d_pre, "encode_bias": d_pre.sum(0), "value": h.T @ d_value, "gate": h.T @ d_gate,
            "pick": (f["value"] * f["gate"]).T @ d_logit, "out": f["z"].T @ error, "out_bias": error.sum(0),
        }

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.forward(bags_of(raw, offsets, words_of(raw, offsets)))["score"]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11, batch: int = 64) -> AttentionScorer:
    model = AttentionScorer(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.values.items()}
    second = {k: np.zeros_like(v) for k, v in model.values.items()}
    target, step = np.array(labels, dtype=np.float32), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            raw, offsets = text_arrays([texts[i] for i in pick])
            bags = bags_of(raw, offsets, words_of(raw, offsets))
            grads = model.gradients(bags, model.forward(bags), target[pick])
            step += 1
            for k, value in model.values.items():
                grad, m, v = grads[k] + 1e-5 * value, first[k], second[k]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= (0.01 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> AttentionScorer | None:
    """Train on labels outside the held-out fold (crc32 of doc_id modulo 5 equal to 0)."""
    texts, quality = labelled_sample(docs, labels.filter(fold("doc_id", 5) != 0), "quality", TRAIN_DOCS)
    return train(texts, quality) if texts else None


def score_documents(docs: DataFrame, model: AttentionScorer | None) -> DataFrame:
    """doc_id, score and predicted (1 from a score of 0.3 on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffer(batch.column("text"))
            for lo, hi in row_slices(offsets):
                found = model.score(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.record_batch([batch.column("doc_id")[lo:hi], pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    if model is None:
        scored = docs.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
