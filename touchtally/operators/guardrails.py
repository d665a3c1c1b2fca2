"""Non-inferiority guardrails on one row per experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchtally.functions.columns import as_column, derive, guarded_ratio
from touchtally.functions.special import norm_ppf, normal_cdf, student_sf
from touchtally.operators.estimators import Input, two_proportion_test, welch_test

PASS, FAIL, INCONCLUSIVE = "PASS", "FAIL", "INCONCLUSIVE"
LOWER_IS_BETTER, HIGHER_IS_BETTER = "lower_is_better", "higher_is_better"
# Guardrails keep their own significance and power.
GUARDRAIL_ALPHA = 0.05
GUARDRAIL_POWER = 0.80
_FIELDS = (
    "verdict", "control_value", "treatment_value", "harm", "harm_ci_low", "harm_ci_high", "margin",
    "non_inferiority_p", "resolvable_margin", "adequately_powered", "error",
)


def _reach(alpha: float, power: float) -> float:
    return norm_ppf(1.0 - alpha / 2.0) + norm_ppf(power)


def minimum_resolvable_margin(
    base_rate: Column | str, n_c: Column | str, n_t: Column | str,
    alpha: float = GUARDRAIL_ALPHA, power: float = GUARDRAIL_POWER, assumed_harm: float = 0.0,
) -> Column:
    """Smallest margin the sample can clear; NULL outside 0 < rate < 1 or without units."""
    p, n_c, n_t = as_column(base_rate), as_column(n_c), as_column(n_t)
    variance = p * (1 - p)
    se = F.sqrt(guarded_ratio(variance, n_c) + guarded_ratio(variance, n_t))
    return F.when((p > 0) & (p < 1), assumed_harm + _reach(alpha, power) * se)


def required_n_for_margin(
    base_rate: Column | str, margin: Column | str,
    alpha: float = GUARDRAIL_ALPHA, power: float = GUARDRAIL_POWER, assumed_harm: float = 0.0,
) -> Column:
    """Units per arm that resolve ``margin``; NULL when it does not exceed the assumed harm."""
    p, room = as_column(base_rate), as_column(margin) - assumed_harm
    ratio = guarded_ratio(F.lit(_reach(alpha, power)), room)
    return F.when((p > 0) & (p < 1), F.ceil(2 * p * (1 - p) * ratio * ratio))


def classify(ci_low: str, ci_high: str, margin: str) -> str:
    """PASS below the margin, FAIL above it, INCONCLUSIVE across it."""
    return f"CASE WHEN {ci_high} < {margin} THEN '{PASS}' WHEN {ci_low} > {margin} THEN '{FAIL}' ELSE '{INCONCLUSIVE}' END"


def _sign(direction: str) -> int:
    if direction not in (LOWER_IS_BETTER, HIGHER_IS_BETTER):
        raise ValueError(f"unknown direction {direction!r}")
    return 1 if direction == LOWER_IS_BETTER else -1


def _guardrail(
    tested: DataFrame, before: DataFrame, name: str, margin: Input, direction: str,
    non_inferiority: Column, resolvable: Column | str,
) -> DataFrame:
    sign = _sign(direction)
    low, high = ("ci_low", "ci_high") if sign > 0 else ("ci_high", "ci_low")
    valid = f"coalesce(_g_error IS NULL AND {name}_margin > 0, false)"
    verdict = classify(f"{name}_harm_ci_low", f"{name}_harm_ci_high", f"{name}_margin")
    df = derive(tested, {
        f"{name}_control_value": "_g_control_mean",
        f"{name}_treatment_value": "_g_treatment_mean",
        f"{name}_margin": f"DOUBLE({margin})",
        f"{name}_harm": f"{sign} * _g_absolute_effect",
        f"{name}_harm_ci_low": f"{sign} * _g_{low}",
        f"{name}_harm_ci_high": f"{sign} * _g_{high}",
        "_g_distance": f"IF(_g_standard_error = 0, 0D, try_divide({name}_harm - {name}_margin, _g_standard_error))",
        f"{name}_non_inferiority_p": non_inferiority,
        f"{name}_resolvable_margin": resolvable,
        f"{name}_adequately_powered": f"{name}_margin >= {name}_resolvable_margin",
        f"{name}_verdict": f"IF({valid}, {verdict}, '{INCONCLUSIVE}')",
        f"{name}_error": f"IF({valid}, NULL, coalesce(_g_error, 'margin must be positive'))",
    })
    return df.select(*before.columns, *[f"{name}_{field}" for field in _FIELDS])


def guardrail_proportion(
    df: DataFrame, name: str, x_c: Input, n_c: Input, x_t: Input, n_t: Input,
    margin: Input, direction: str = LOWER_IS_BETTER, alpha: float = GUARDRAIL_ALPHA,
) -> DataFrame:
    """Guardrail on a rate. Harm is positive when the metric gets worse."""
    tested = two_proportion_test(df, x_c, n_c, x_t, n_t, alpha, "_g_")
    base = F.expr(f"try_divide({x_c} + {x_t}, {n_c} + {n_t})")
    resolvable = F.coalesce(
        minimum_resolvable_margin(base, F.expr(str(n_c)), F.expr(str(n_t)), alpha), F.lit(0.0)
    )
    return _guardrail(tested, df, name, margin, direction, normal_cdf(F.col("_g_distance")), resolvable)


def guardrail_mean(
    df: DataFrame, name: str, control: tuple[Input, Input, Input], treatment: tuple[Input, Input, Input],
    margin: Input, direction: str = LOWER_IS_BETTER, alpha: float = GUARDRAIL_ALPHA,
) -> DataFrame:
    """Guardrail on a mean, from (count, mean, sample variance) of each arm."""
    tested = welch_test(df, control, treatment, alpha, "_g_")
    p_value = student_sf(F.expr("-_g_distance"), F.col("_g_degrees_of_freedom"))
    resolvable = f"{_reach(alpha, GUARDRAIL_POWER)!r}D * _g_standard_error"
    return _guardrail(tested, df, name, margin, direction, p_value, resolvable)


def guardrail_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per experiment and guardrail."""
    packed = ", ".join(
        f"struct('{n}' AS guardrail, " + ", ".join(f"{n}_{field} AS {field}" for field in _FIELDS) + ")"
        for n in names
    )
    return df.selectExpr("experiment_id", f"inline(array({packed}))")


def guardrail_report(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add ``guardrails_passed``, ``guardrails_blocking`` and ``guardrails_underpowered``.

    An inconclusive guardrail blocks like a failed one.
    """
    blocking = ", ".join(f"IF({n}_verdict <> '{PASS}', concat('{n} (', {n}_verdict, ')'), NULL)" for n in names)
    weak = ", ".join(f"IF(coalesce({n}_adequately_powered, false), NULL, '{n}')" for n in names)
    return derive(df, {
        "guardrails_blocking": f"array_compact(array({blocking}))",
        "guardrails_underpowered": f"array_compact(array({weak}))",
        "guardrails_passed": "size(guardrails_blocking) = 0",
    })
