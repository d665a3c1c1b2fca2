"""Whitening of embeddings by principal components.

Vectors are put on an integer grid, so equal ones are exactly equal and sums are exact. The mean
and the covariance come from the distinct grid vectors, in two passes: sums, then products of
centred entries. Entries are centred on the mean rounded to the grid, and the remaining part of a
step is taken off with exact integers, so the components don't depend on the order of tasks as long
as sums of squares stay below 2**53.

The covariance (dimension squared, whatever the number of rows) is decomposed on the driver:
Householder reflections make it tridiagonal, Sturm counts bisect the leading eigenvalues, inverse
iteration gives vectors, those of close eigenvalues are kept orthogonal, and the reflections
bring them back. The projection is sent to all tasks and applied to all rows.

Cases: rows whose vector is null or holds null or non-finite entries are left out, and so are entries
beyond a long and vectors of another length than most distinct ones (the longer on a tie). Repeated rows are
all projected and count once in the fit. Components whose eigenvalue is within rounding of 0 don't exist: a table of
equal vectors, or an empty one, gives no row. A deviation beyond a long is null. Null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import written

GRID = 256
COMPONENTS = 4
BLOCK_ROWS = 2048
_EPS = np.finfo(float).eps
# Eigenvalues nearer than this part of the norm form a cluster.
_CLUSTER = 1e-3


def on_grid(embeddings: DataFrame, vector: str = "embedding", grid: int = GRID) -> DataFrame:
    """embeddings with ``_x``, the grid vector as longs; rows that have none are left out."""
    entries = F.transform(F.col(vector), lambda c: c.cast("double") * F.lit(float(grid)))
    # NaN is above every number, so it fails the second comparison.
    whole = F.forall(entries, lambda c: F.coalesce((c >= -(2.0**63)) & (c < 2.0**63), F.lit(False)))
    return embeddings.filter(F.col(vector).isNotNull() & whole).withColumn("_x", F.transform(entries, lambda c: F.floor(c).cast("long")))


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(fit: DataFrame, d: int, block, width: int) -> np.ndarray:
    """Sum over all blocks of rows of ``block(matrix)``, ``width`` doubles; a task sends one row per place."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                out += block(_matrix(batch.slice(lo, BLOCK_ROWS), "_x", d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int64)), pa.array(out)], ["place", "value"])

    # Few partial results per core, however many files there are.
    parts = max(1, 4 * fit.sparkSession.sparkContext.defaultParallelism)
    sums = fit.select("_x").coalesce(parts).mapInArrow(total, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width)
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflectors that lead there; the last k rows of reflector k are its support."""
    a, reflectors = v.astype(float).copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size > 0:
            x[0] += np.copysign(size, x[0])
            x /= np.linalg.norm(x)
            lower = a[k + 1 :, k + 1 :]
            p = 2 * (lower @ x)
            p -= (x @ p) * x
            lower -= np.outer(x, p) + np.outer(p, x)
            a[k + 1, k] = -np.copysign(size, a[k + 1, k])
        reflectors.append(x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues are below each of ``at``."""
    tiny = np.finfo(float).tiny / _EPS
    q = diagonal[0] - at
    below = (q < 0).astype(int)
    for a, b in zip(diagonal[1:], off):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = a - at - b * b / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bits."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    high += _EPS * np.abs(high) + np.finfo(float).tiny
    rank = d - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(128):
        middle = low + (high - low) / 2
        above = count_below(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))):
            break
    return low + (high - low) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, value: float) -> tuple[list, list]:
    """Elimination with row exchanges of the shifted tridiagonal: rows of the upper factor, and the steps."""
    small = _EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    upper, steps = [], []
    now = (diagonal[0] - value, off[0] if len(off) else 0.0, 0.0)
    for i in range(len(off)):
        below = (off[i], diagonal[i + 1] - value, off[i + 1] if i + 1 < len(off) else 0.0)
        swap = abs(below[0]) > abs(now[0])
        first, second = (below, now) if swap else (now, below)
        pivot = first[0] if abs(first[0]) > small else small
        times = second[0] / pivot
        upper.append((pivot, first[1], first[2]))
        steps.append((swap, times))
        now = (second[1] - times * first[1], second[2] - times * first[2], 0.0)
    upper.append((now[0] if abs(now[0]) > small else small, 0.0, 0.0))
    return upper, steps


def _solve(upper: list, steps: list, right: np.ndarray) -> np.ndarray:
    y = right.tolist()
    for i, (swap, times) in enumerate(steps):
        if swap:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= times * y[i]
    for i in range(len(y) - 1, -1, -1):
        pivot, one, two = upper[i]
        rest = y[i] - (one * y[i + 1] if i + 1 < len(y) else 0.0) - (two * y[i + 2] if i + 2 < len(y) else 0.0)
        y[i] = rest / pivot
    return np.array(y)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit vectors (columns) for falling eigenvalues; inside a cluster each is kept orthogonal to the ones before."""
    norm = max(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    rng, out, first = np.random.default_rng(7), np.zeros((len(diagonal), len(values))), 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > _CLUSTER * norm:
            first = j
        # Equal eigenvalues get shifts a few roundings apart.
        shift = min(value, shift - 10 * _EPS * norm) if j > first else value
        upper, steps = _factors(diagonal, off, shift)
        z = rng.standard_normal(len(diagonal))
        for _ in range(rounds):
            z = _solve(upper, steps, z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, first:j] @ (out[:, first:j].T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; the largest entry is positive."""
    scale = np.abs(v).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, reflectors = tridiagonal(v / scale)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * _EPS * max(values[0], 0.0)]
    vectors = inverse_iteration(diagonal, off, values)
    for x in reversed(reflectors):
        if x.any():
            rows = vectors[-len(x) :]
            rows -= 2 * np.outer(x, x @ rows)
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values * scale, vectors


@dataclass(frozen=True)
class Whitening:
    """Mean, components and scale of a fit."""

    n: int
    sums: np.ndarray  # exact, as Python integers
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened grid vectors. The mean's whole part goes off first, in integers."""
        near, left = _mean(self.n, self.sums)
        centred = x.astype(float) - near.astype(float) - left.astype(float) / self.n
        out = np.zeros((len(x), len(self.values)))
        # Added in order of dimension, so a row's result doesn't depend on the rows beside it.
        for column, weights in zip(centred.T, self.vectors / np.sqrt(self.values)):
            out += column[:, None] * weights
        return out

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum of (n * x - sums)**2, exact; -1 beyond a long."""
        near, left = _mean(self.n, self.sums)
        rough = ((self.n * (x.astype(float) - near.astype(float)) - left.astype(float)) ** 2).sum(axis=1)
        safe = rough < 2.0**62
        out = np.full(len(x), -1, dtype=np.int64)
        moved = self.n * (x[safe] - near) - left.astype(np.int64)
        out[safe] = (moved * moved).sum(axis=1)
        for i in np.flatnonzero(~safe & (rough < 2.0**64)):
            exact = sum((self.n * int(a) - int(s)) ** 2 for a, s in zip(x[i], self.sums))
            out[i] = exact if exact < 2**63 else -1
        return out


def _mean(n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean rounded to the grid, and what n of it leave of the sums, at most n / 2; both exact."""
    near = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=object)
    return near.astype(np.int64), np.array([int(s) - n * m for s, m in zip(sums, near)], dtype=object)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct ``_x`` of ``vectors``; None without vectors or without spread."""
    distinct = written(vectors.select("_x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return None
    d, n = int(lengths["d"]), int(lengths["count"])
    kept = distinct.filter(F.size("_x") == d)
    # High and low halves, so that sums of doubles are exact.
    halves = _totals(kept, d, lambda x: np.concatenate([(x >> 26).sum(axis=0, dtype=float), (x & (2**26 - 1)).sum(axis=0, dtype=float)]), 2 * d)
    sums = np.array([(int(high) << 26) + int(low) for high, low in zip(halves[:d], halves[d:])], dtype=object)
    near, left = _mean(n, sums)
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        y = x.astype(float) - near.astype(float)
        return (y.T @ y)[upper]

    moments = _totals(kept, d, products, len(upper[0]))
    covariance = np.zeros((d, d))
    for i, j, moment in zip(*upper, moments):
        covariance[i, j] = covariance[j, i] = (n * int(moment) - left[i] * left[j]) / (n * n)
    values, axes = leading_components(covariance, components)
    if not len(values):
        return None
    found = Whitening(n, sums, values, axes, float(np.trace(covariance)), 0.0)
    k = len(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = found.project(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    whole = _totals(kept, d, spread, k + k * k) / n
    error = whole[k:].reshape(k, k) - np.outer(whole[:k], whole[:k]) - np.eye(k)
    return Whitening(n, sums, values, axes, found.trace, float(np.abs(error).max()))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    placed = on_grid(embeddings.select("vec_id", vector), vector)
    found = fit(placed, components)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    k, explained = len(found.values), found.values / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(lo, BLOCK_ROWS)
                x = _matrix(rows, "_x", found.dimension)
                m = len(x)
                deviation = np.repeat(found.deviation(x), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("vec_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, found.n, dtype=np.int64)),
                        pa.array(deviation, mask=deviation < 0),
                        pa.array(found.project(x).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, found.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return placed.filter(F.size("_x") == found.dimension).select("vec_id", "_x").mapInArrow(project, _RESULT)
