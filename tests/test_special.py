import math

import numpy as np
import pytest

from touchtally.functions import special as s
from touchtally.operators.sequential import alpha_spent, boundaries, check_fractions


@pytest.mark.parametrize("z, p", [(0.0, 0.5), (1.959963984540054, 0.025), (6.0, 9.865876450377018e-10)])
def test_normal(z, p):
    assert s.norm_sf(z) == pytest.approx(p, rel=1e-12)
    assert s.norm_cdf(-z) == pytest.approx(p, rel=1e-12)


@pytest.mark.parametrize("t, df, p", [(1.0, 1, 0.25), (2.0, 10, 0.03669401738537), (math.sqrt(2), 2, (1 - 1 / math.sqrt(2)) / 2)])
def test_student_tail_and_quantile(t, df, p):
    assert s.t_sf(t, df) == pytest.approx(p, rel=1e-10)
    assert s.t_sf(-t, df) == pytest.approx(1 - p, rel=1e-10)
    assert s.t_ppf(1 - p, df) == pytest.approx(t, rel=1e-9)


@pytest.mark.parametrize("df", [1e6, 9.9e6, 1.01e7, 1e8, 1e10])
@pytest.mark.parametrize("t", [0.5, 2.0, 6.0, 10.0])
def test_student_with_many_degrees(t, df):
    """Against the expansion of the tail in powers of 1 / df; no step anywhere."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    first = (t**3 + t) / (4 * df)
    second = (3 * t**7 - 7 * t**5 - 5 * t**3 - 3 * t) / (96 * df**2)
    assert s.t_sf(t, df) == pytest.approx(s.norm_sf(t) + density * (first + second), rel=1e-8)


def test_both_ways_of_the_student_tail_agree(monkeypatch):
    plain = [s.t_sf(t, 9e4) for t in (0.0, 0.5, 2.0, 6.0, 10.0)]
    monkeypatch.setattr(s, "_INTEGRATED_DF", 1.0)
    assert [s.t_sf(t, 9e4) for t in (0.0, 0.5, 2.0, 6.0, 10.0)] == pytest.approx(plain, rel=1e-9)
    assert s.t_ppf(0.975, 1e6) == pytest.approx(1.959966356814107, rel=1e-10)


def test_student_quantile():
    assert s.t_ppf(0.975, 5) == pytest.approx(2.570581835636314, rel=1e-10)


@pytest.mark.parametrize("x, k, p", [(3.841458820694124, 1, 0.05), (4.0, 2, math.exp(-2)), (2.0, 4, 2 * math.exp(-1)), (30.0, 4, 16 * math.exp(-15))])
def test_chi_square(x, k, p):
    assert s.chi2_sf(x, k) == pytest.approx(p, rel=1e-9)
    assert s.chi2_sf(s.chi2_ppf(0.999, k), k) == pytest.approx(0.001, rel=1e-9)


def test_incomplete_beta_closed_forms():
    for x in (0.1, 0.5, 0.93):
        assert s.beta_inc(1, 3, x) == pytest.approx(1 - (1 - x) ** 3, rel=1e-12)
        assert s.beta_inc(2, 1, x) == pytest.approx(x**2, rel=1e-12)
        assert s.beta_inc(5, 7, x) + s.beta_inc(7, 5, 1 - x) == pytest.approx(1.0)


COUNTS = [(500, 10000, 560, 10000), (30, 200, 25, 200), (2, 50, 9, 50), (2370, 29967, 2661, 30033),
          (80_000_000, 10**9, 80_100_000, 10**9), (5, 100, 60_000, 1_000_000)]


def arms(xc, nc, xt, nt):
    return s.BetaArm(1 + xc, 1 + nc - xc), s.BetaArm(1 + xt, 1 + nt - xt)


@pytest.mark.parametrize("counts", COUNTS)
def test_losses_differ_by_the_effect(counts):
    c, t = arms(*counts)
    hold, ship = s.expected_shortfall(c, t), s.expected_shortfall(t, c)
    assert hold - ship == pytest.approx(t.mean - c.mean, abs=1e-9)


def test_published_posterior():
    c, t = arms(2369, 29967, 2661, 30033)
    assert s.prob_lift_exceeds(c, t, 0.0) == pytest.approx(1.0, abs=5e-5)
    assert s.prob_lift_exceeds(c, t, 0.005) == pytest.approx(0.9778, abs=5e-5)
    assert s.expected_shortfall(c, t) == pytest.approx(0.009548, abs=5e-7)


def test_posterior_against_draws():
    rng = np.random.default_rng(7)
    for counts in COUNTS[:3]:
        c, t = arms(*counts)
        gap = rng.beta(t.a, t.b, 400_000) - rng.beta(c.a, c.b, 400_000)
        assert s.prob_lift_exceeds(c, t, 0.01) == pytest.approx((gap > 0.01).mean(), abs=4e-3)
        for q in (0.025, 0.5, 0.975):
            assert (gap <= s.lift_quantile(c, t, q)).mean() == pytest.approx(q, abs=4e-3)


def test_equal_uniform_posteriors():
    u = s.BetaArm(1, 1)
    assert s.prob_lift_exceeds(u, u, 0.0) == pytest.approx(0.5)
    assert s.expected_shortfall(u, u) == pytest.approx(1 / 6)


FIVE = (0.2, 0.4, 0.6, 0.8, 1.0)


def test_published_boundaries():
    z = [b for b, _ in boundaries(FIVE, 0.05, "obrien_fleming")]
    assert z == pytest.approx([4.383, 3.099, 2.551, 2.254, 2.064], abs=1e-3)
    pocock = [b for b, _ in boundaries(FIVE, 0.05, "pocock")]
    assert np.mean(pocock) == pytest.approx(2.41, abs=0.05) and np.std(pocock) < 0.03


def test_single_look_is_the_fixed_test():
    for name in ("obrien_fleming", "pocock", "linear"):
        assert boundaries((1.0,), 0.05, name)[0][0] == pytest.approx(1.96, abs=0.01)


def test_boundaries_keep_the_level_under_simulated_looks():
    rng = np.random.default_rng(3)
    steps = rng.normal(0, math.sqrt(0.2), size=(60_000, 5)).cumsum(axis=1) / np.sqrt(FIVE)
    for name in ("obrien_fleming", "pocock", "linear"):
        bounds = np.array([b for b, _ in boundaries(FIVE, 0.05, name)])
        assert (np.abs(steps) >= bounds).any(axis=1).mean() == pytest.approx(0.05, abs=0.004)
    assert (np.abs(steps) >= 1.96).any(axis=1).mean() == pytest.approx(0.142, abs=0.006)


def test_spending():
    assert alpha_spent("pocock", 0.0, 0.05) == 0.0 and alpha_spent("linear", 1.5, 0.05) == 0.05
    assert alpha_spent("linear", 0.4, 0.05) == pytest.approx(0.02)
    with pytest.raises(ValueError):
        alpha_spent("flat", 0.5, 0.05)
    for bad in ((), (0.0, 1.0), (0.5, 0.5), (0.5, 1.2)):
        with pytest.raises(ValueError):
            check_fractions(bad, 0.05)
    with pytest.raises(ValueError):
        check_fractions((1.0,), 1.5)
