"""Whitening against a dense eigensolver, and the solver on hard spectra."""

import math

import numpy as np
import pytest

from touchtally.llm.whitening import count_below, leading_components, tridiagonal, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, component int, whitened double"


def framed(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 9, 0.5) for i, v in vectors], SCHEMA)


def brute(vectors, d, k=4):
    """{(id, place): rows} by plain loops over Python numbers and numpy's solver."""
    grids = []
    for i, v in vectors:
        if v is None or len(v) != d or any(c is None or not math.isfinite(c) for c in v):
            continue
        grids.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    fit = sorted({x for _, x in grids})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in grids:
        white = (np.array(x) - np.array(sums) / n) @ vectors / np.sqrt(values)
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out.append((i, n, deviation, white, values / np.trace(cov)))
    return out


def collected(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["vec_id"], []).append(r)
    return {i: sorted(rs, key=lambda r: r["component"]) for i, rs in rows.items()}


def test_whiten(spark):
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((300, 10)) * np.arange(1, 11)).tolist()
    vectors = [(i, v) for i, v in enumerate(data)] + [(900 + i, data[0]) for i in range(100)]
    vectors += [(1000, None), (1001, [1.0] * 9 + [None]), (1002, [float("nan")] * 10), (1003, [float("inf")] * 10), (1004, [1.0, 2.0]), (1005, [])]
    got = collected(whiten(framed(spark, vectors).repartition(7)))
    expected = brute(vectors, 10)
    assert sorted(got) == sorted(i for i, *_ in expected)
    sign = np.sign([r["whitened"] for r in got[0]]) * np.sign(expected[0][3])
    for i, n, deviation, white, explained in expected:
        assert [r["component"] for r in got[i]] == [1, 2, 3, 4]
        assert all(r["n"] == n and r["deviation"] == deviation for r in got[i])
        assert np.allclose([r["whitened"] for r in got[i]], white * sign, atol=1e-9)
        assert np.allclose([r["explained"] for r in got[i]], explained, rtol=1e-10)
        assert got[i][0]["identity_error"] < 1e-10


def test_reruns_agree(spark):
    data = np.random.default_rng(6).standard_normal((500, 8)).tolist()
    frames = [framed(spark, list(enumerate(data))).repartition(p) for p in (1, 5, 11)]
    # The error itself is a matter of roundings.
    results = [sorted(map(tuple, whiten(f).drop("identity_error").collect())) for f in frames]
    assert results[0] == results[1] == results[2]


def test_no_spread_and_empty(spark):
    assert whiten(framed(spark, [])).collect() == []
    assert whiten(framed(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []


def test_few_dimensions_and_null_ids(spark):
    rows = whiten(framed(spark, [(None, [0.0, 1.0]), (None, [1.0, 3.0]), (2, [2.0, 5.0])])).collect()
    # All on one line: one component.
    assert [r["component"] for r in rows] == [1, 1, 1] and {r["vec_id"] for r in rows} == {None, 2}
    assert sorted(round(r["whitened"] ** 2, 9) for r in rows) == [0.0, 1.5, 1.5]


def test_deviation_beyond_a_long(spark):
    rows = collected(whiten(framed(spark, [(1, [0.0, 0.0]), (2, [3e13, 0.0]), (3, [0.0, 1.0])])))
    assert rows[2][0]["deviation"] is None
    rows = collected(whiten(framed(spark, [(1, [1e12, 0.0]), (2, [1e12, 1.0]), (3, [1e12, 3.0])])))
    assert [rows[i][0]["deviation"] for i in (1, 2, 3)] == [1024**2, 256**2, 1280**2]


SPECTRA = {
    "apart": np.arange(12.0),
    "equal": np.array([5.0] * 3 + [1.0] * 9),
    "close": np.array([5, 5 - 1e-9, 5 - 1e-7, 5 - 1e-4] + [1] * 8, dtype=float),
    "far": 10.0 ** -np.arange(12),
    "low rank": np.array([3.0, 2.0] + [0.0] * 10),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("rotate", [True, False])
def test_components(name, rotate):
    values = SPECTRA[name]
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0] if rotate else np.eye(12)
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    found, vectors = leading_components(v, 4)
    top = np.sort(values)[::-1][: len(found)]
    assert len(found) == (2 if name == "low rank" else 4)
    assert np.abs(found - top).max() <= 1e-14 * values.max()
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-13 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() <= 1e-13


def test_sturm_counts():
    v = np.random.default_rng(4).standard_normal((9, 9))
    v = v + v.T
    diagonal, off, _ = tridiagonal(v)
    values = np.linalg.eigvalsh(v)
    assert count_below(diagonal, off, values + 1e-6).tolist() == list(range(1, 10))
    assert count_below(diagonal, off, values - 1e-6).tolist() == list(range(9))
