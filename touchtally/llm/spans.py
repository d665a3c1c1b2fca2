"""Numbers that describe spans of text (lines, passages), for the trained classifiers."""

from __future__ import annotations

import numpy as np

from touchtally.llm.common import Words

SYMBOLS = b"#*$%&|<>"
WORD_BINS = (1, 3, 6, 11, 31)
NAMES = (
    "bias", *(f"words_bin_{i}" for i in range(len(WORD_BINS) + 1)), "symbols", "bangs", "upper", "digits", "bars",
    "sentence_end", "repeats", "word_length", "wide",
)


def _upto(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_IS = {
    "symbol": _table(SYMBOLS), "bang": _table(b"!"), "bar": _table(b"|"), "digit": _table(b"0123456789"),
    "upper": _table(bytes(range(65, 91))), "lower": _table(bytes(range(97, 123))), "wide": _table(bytes(range(128, 256))),
}


def distinct_in_spans(span: np.ndarray, hashes: np.ndarray, n_spans: int) -> np.ndarray:
    """Distinct hashes in each span; ``span`` names the span of each hash, in ascending order."""
    order = np.lexsort((hashes, span))
    s, h = span[order], hashes[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
    return np.bincount(s[new], minlength=n_spans)


def describe(raw: np.ndarray, start: np.ndarray, end: np.ndarray, words: Words) -> np.ndarray:
    """One row of features in [0, 1] for each span [start, end) of bytes; spans ascend and do not overlap."""
    n = len(start)
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n_words = last - first
    count = {}
    for name, table in _IS.items():
        sums = _upto(table[raw])
        count[name] = sums[end] - sums[start]
    size = np.maximum(end - start, 1)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    at_least_one = np.maximum(n_words, 1)
    lengths = np.concatenate([[0], np.cumsum(words.end - words.start)])
    span = np.repeat(np.arange(n), n_words)
    member = np.arange(len(span)) + np.repeat(first - (np.cumsum(n_words) - n_words), n_words)
    distinct = distinct_in_spans(span, words.hash[member], n)
    closing = np.zeros(n, dtype=bool)
    filled = n_words > 0
    closing[filled] = _table(b".!?")[raw[words.end[last[filled] - 1] - 1]]
    out = np.zeros((n, len(NAMES)), dtype=np.float32)
    out[:, 0] = 1
    out[np.arange(n), 1 + np.searchsorted(WORD_BINS, n_words, side="right")] = 1
    at = 2 + len(WORD_BINS)
    out[:, at] = np.minimum(1, 4 * count["symbol"] / size)
    out[:, at + 1] = np.minimum(1, count["bang"] / at_least_one)
    out[:, at + 2] = count["upper"] / letters
    out[:, at + 3] = np.minimum(1, 2 * count["digit"] / size)
    out[:, at + 4] = np.minimum(1, count["bar"] / at_least_one)
    out[:, at + 5] = closing
    out[:, at + 6] = (n_words - distinct) / at_least_one
    out[:, at + 7] = np.minimum(1, (lengths[last] - lengths[first]) / at_least_one / 16)
    out[:, at + 8] = np.minimum(1, 2 * count["wide"] / size)
    return out
