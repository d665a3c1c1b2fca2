"""Two-sample tests as columns on one row per experiment.

Each function adds ``<prefix>``-named columns. A row whose inputs are not valid
keeps NULL results and gets a message in ``<prefix>error``; other rows go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchtally.functions.columns import derive
from touchtally.functions.special import (
    normal_quantile,
    normal_sf,
    student_quantile,
    student_sf,
)
from touchtally.sources.checkpoints import broadcast_if_small, materialise

# Inputs of the tests are column names, SQL expressions or numbers.
Input = str | float


def _interval(prefix: str, p_value: Column, alpha: Input) -> dict[str, Column | str]:
    p = prefix
    return {
        f"{p}p_value": p_value,
        f"{p}ci_low": f"{p}absolute_effect - {p}critical * {p}standard_error",
        f"{p}ci_high": f"{p}absolute_effect + {p}critical * {p}standard_error",
        f"{p}significant": f"{p}p_value < {alpha}",
    }


def z_statistic(x_c: Input, n_c: Input, x_t: Input, n_t: Input) -> str:
    """Pooled two-proportion z; 0 without variance, NULL without units in an arm."""
    pooled = f"try_divide({x_c} + {x_t}, {n_c} + {n_t})"
    se = f"sqrt(greatest({pooled} * (1 - {pooled}), 0) * (try_divide(1D, {n_c}) + try_divide(1D, {n_t})))"
    effect = f"(try_divide({x_t}, {n_t}) - try_divide({x_c}, {n_c}))"
    return f"CASE WHEN {se} > 0 THEN {effect} / {se} WHEN {se} = 0 THEN 0D END"


def two_proportion_test(
    df: DataFrame, x_c: Input, n_c: Input, x_t: Input, n_t: Input,
    alpha: Input = "alpha", prefix: str = "", two_sided: bool = True,
) -> DataFrame:
    """Two-proportion z-test: pooled error for z, unpooled for the interval."""
    p = prefix
    valid = (
        f"coalesce({n_c} > 0 AND {n_t} > 0 AND {x_c} BETWEEN 0 AND {n_c} AND {x_t} BETWEEN 0 AND {n_t}, false)"
    )

    def spread(arm: str, n: Input) -> str:
        return f"try_divide({p}{arm}_mean * (1 - {p}{arm}_mean), {n})"

    tail = F.expr(f"abs({p}statistic)" if two_sided else f"{p}statistic")
    return derive(df, {
        f"{p}error": f"IF({valid}, NULL, 'needs units in both arms and conversions within them')",
        f"{p}control_mean": f"IF({valid}, {x_c} / {n_c}, NULL)",
        f"{p}treatment_mean": f"IF({valid}, {x_t} / {n_t}, NULL)",
        f"{p}absolute_effect": f"{p}treatment_mean - {p}control_mean",
        f"{p}relative_effect": f"try_divide({p}absolute_effect, {p}control_mean)",
        f"{p}standard_error": f"sqrt({spread('control', n_c)} + {spread('treatment', n_t)})",
        f"{p}statistic": f"IF({valid}, {z_statistic(x_c, n_c, x_t, n_t)}, NULL)",
        f"{p}critical": normal_quantile(F.expr(f"DOUBLE(1 - {alpha} / {2 if two_sided else 1})")),
        **_interval(p, normal_sf(tail) * (2 if two_sided else 1), alpha),
    })


def welch_test(
    df: DataFrame, control: tuple[Input, Input, Input], treatment: tuple[Input, Input, Input],
    alpha: Input = "alpha", prefix: str = "", two_sided: bool = True,
) -> DataFrame:
    """Welch's t-test from (count, mean, sample variance) of each arm."""
    p = prefix
    (n_c, m_c, v_c), (n_t, m_t, v_t) = control, treatment
    enough = f"coalesce({n_c} >= 2 AND {n_t} >= 2, false)"
    part_c, part_t = f"try_divide({v_c}, {n_c})", f"try_divide({v_t}, {n_t})"
    valid = f"coalesce({enough} AND {part_c} + {part_t} > 0, false)"
    tail = F.expr(f"abs({p}statistic)" if two_sided else f"{p}statistic")
    dof = F.col(f"{p}degrees_of_freedom")
    return derive(df, {
        f"{p}error": f"CASE WHEN NOT {enough} THEN 'needs two observations in each arm' "
                     f"WHEN NOT {valid} THEN 'no variance in either arm' END",
        f"{p}control_mean": f"{m_c}",
        f"{p}treatment_mean": f"{m_t}",
        f"{p}absolute_effect": f"IF({valid}, {m_t} - {m_c}, NULL)",
        f"{p}relative_effect": f"try_divide({p}absolute_effect, {m_c})",
        f"{p}standard_error": f"IF({valid}, sqrt({part_c} + {part_t}), NULL)",
        f"{p}degrees_of_freedom": f"""IF({valid}, try_divide(
            power({part_c} + {part_t}, 2),
            try_divide(power({part_c}, 2), {n_c} - 1) + try_divide(power({part_t}, 2), {n_t} - 1)), NULL)""",
        f"{p}statistic": f"{p}absolute_effect / {p}standard_error",
        f"{p}critical": student_quantile(F.expr(f"DOUBLE(1 - {alpha} / {2 if two_sided else 1})"), dof),
        **_interval(p, student_sf(tail, dof) * (2 if two_sided else 1), alpha),
    })


# Pooled cov(y, x) / var(x); 0 without variance.
_THETA = "coalesce(IF(x_var > 0, xy_cov / x_var, NULL), 0D)"


def cuped_adjusted_rows(assignments: DataFrame, moments: DataFrame) -> DataFrame:
    """Units with ``adjusted_metric`` = y - theta * (x - pooled mean of x).

    Two passes: the three numbers per experiment are computed and written first,
    then every unit is adjusted without a shuffle. Units without covariate get
    NULL.
    """
    terms = materialise(
        moments.selectExpr("experiment_id", f"{_THETA} AS theta", "x_mean AS covariate_mean")
    )
    return assignments.join(broadcast_if_small(terms), "experiment_id").withColumn(
        "adjusted_metric", F.expr("primary_metric - theta * (pre_covariate - covariate_mean)")
    )


def cuped_two_sample(moments: DataFrame, alpha: Input = "alpha", two_sided: bool = True) -> DataFrame:
    """Raw and CUPED-adjusted Welch tests (prefixes ``raw_`` and ``cuped_``).

    The adjusted moments follow from the raw ones, so the units are not read a
    second time.
    """
    adjusted = {"theta": _THETA}
    for a in ("c", "t"):
        adjusted[f"_mean_{a}"] = f"y_mean_{a} - theta * (x_mean_{a} - x_mean)"
        # Rounding may leave the variance of a perfect fit slightly below 0.
        adjusted[f"_var_{a}"] = f"greatest(y_var_{a} - 2 * theta * xy_cov_{a} + theta * theta * x_var_{a}, 0D)"
    df = derive(moments, adjusted)
    df = welch_test(
        df, ("x_n_c", "y_mean_c", "y_var_c"), ("x_n_t", "y_mean_t", "y_var_t"), alpha, "raw_", two_sided
    )
    df = welch_test(
        df, ("x_n_c", "_mean_c", "_var_c"), ("x_n_t", "_mean_t", "_var_t"), alpha, "cuped_", two_sided
    )
    spread = "sqrt(greatest(x_var, 0D) * greatest(y_var, 0D))"
    return derive(df, {
        "correlation": f"coalesce(try_divide(xy_cov, {spread}), 0D)",
        "variance_reduction": "coalesce(1 - try_divide(y_var - 2 * theta * xy_cov + theta * theta * x_var, y_var), 0D)",
        "theoretical_reduction": "correlation * correlation",
        "ci_width_reduction": "coalesce(1 - try_divide(cuped_ci_high - cuped_ci_low, raw_ci_high - raw_ci_low), 0D)",
    }).drop("_mean_c", "_mean_t", "_var_c", "_var_t")
