"""Beta-Binomial comparison of two arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.functions.columns import derive
from touchtally.functions.special import POSTERIOR, posterior_difference
from touchtally.operators.estimators import Input

# Fixed value: the uniform prior.
DEFAULT_PRIOR = (1.0, 1.0)


def posterior_parameters(
    df: DataFrame, x_c: Input, n_c: Input, x_t: Input, n_t: Input,
    prior: tuple[float, float] = DEFAULT_PRIOR,
) -> DataFrame:
    """Add the Beta parameters and means of both posteriors; NULL on invalid counts."""
    if min(prior) <= 0:
        raise ValueError(f"prior parameters must be positive, got {prior}")
    made = {}
    for arm, x, n in (("c", x_c, n_c), ("t", x_t, n_t)):
        a, b = f"posterior_a_{arm}", f"posterior_b_{arm}"
        valid = f"{n} >= 0 AND {x} BETWEEN 0 AND {n}"
        made[a] = f"IF({valid}, {prior[0]!r}D + {x}, NULL)"
        made[b] = f"IF({valid}, {prior[1]!r}D + {n} - {x}, NULL)"
        made[f"posterior_mean_{arm}"] = f"{a} / ({a} + {b})"
    return derive(df, made)


def beta_binomial_test(
    df: DataFrame, x_c: Input, n_c: Input, x_t: Input, n_t: Input,
    threshold: Input = "practical_threshold", level: Input = 0.95,
    prior: tuple[float, float] = DEFAULT_PRIOR,
) -> DataFrame:
    """Posteriors, win probabilities, expected losses and lift interval."""
    df = posterior_parameters(df, x_c, n_c, x_t, n_t, prior)
    compared = posterior_difference(
        *[F.col(f"posterior_{k}_{arm}") for arm in ("c", "t") for k in ("a", "b")],
        F.expr(f"DOUBLE({threshold})"), F.expr(f"DOUBLE({level})"),
    )
    return df.withColumn("_compared", compared).select(
        "*", *[F.col("_compared")[name].alias(name) for name in POSTERIOR.names]
    ).drop("_compared")


def decision_summary(
    df: DataFrame, threshold: Input = "practical_threshold", tolerance: float | None = None
) -> DataFrame:
    """Add ``loss_tolerance``, ``ship_within_tolerance`` and a sentence on the posterior.

    Without a tolerance, a tenth of the practical threshold is used.
    """
    limit = f"DOUBLE({tolerance})" if tolerance is not None else f"abs({threshold}) / 10D"
    verdict = F.when(F.col("ship_within_tolerance"), "shipping is within tolerance").otherwise(
        "the downside is above tolerance"
    )
    percent = [
        F.col(name) * 100
        for name in ("prob_treatment_better", "prob_exceeds_threshold", "expected_loss_ship",
                     "expected_loss_hold", "loss_tolerance")
    ]
    sentence = F.format_string(
        "P(better) %.1f%%, P(lift above threshold) %.1f%%. Expected loss: ship %.4f%%, "
        "hold %.4f%%, tolerance %.4f%%: %s.",
        *percent, verdict,
    )
    return derive(df, {
        "loss_tolerance": limit,
        "ship_within_tolerance": "expected_loss_ship <= loss_tolerance",
        "summary": F.when(F.col("expected_loss_ship").isNotNull(), sentence),
    })
