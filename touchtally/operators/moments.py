"""One aggregate of the assignment table; every estimator reads its row.

All measures merge across partial aggregates, so each task sends one row per
experiment and a hot experiment costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column suffix and name of each arm.
ARMS = {"c": "control", "t": "treatment"}


def arm_moments(assignments: DataFrame) -> DataFrame:
    """Counts, means, variances and covariances per experiment.

    Suffixes ``_c`` and ``_t`` are control and treatment; other variants are
    ignored. ``x`` is the pre-experiment covariate, ``y`` the primary metric on
    units that have the covariate, so that CUPED sees complete pairs; units
    without it count everywhere else.
    """
    x, y = "pre_covariate", "IF(pre_covariate IS NULL, NULL, primary_metric)"
    latency = "guardrail_latency_ms"
    measures = []
    for suffix, variant in ARMS.items():
        here = f"FILTER (WHERE variant = '{variant}')"
        converter = f"variant = '{variant}' AND primary_metric > 0"
        measures += [
            f"count(*) {here} AS n_{suffix}",
            f"coalesce(sum(primary_metric) {here}, 0D) AS conversions_{suffix}",
            f"avg(primary_metric) {here} AS metric_mean_{suffix}",
            f"var_samp(primary_metric) {here} AS metric_var_{suffix}",
            f"count(*) FILTER (WHERE variant = '{variant}' AND guardrail_refund) AS refunds_{suffix}",
            f"count(*) FILTER (WHERE {converter}) AS converters_{suffix}",
            f"count(*) FILTER (WHERE {converter} AND guardrail_refund) AS converter_refunds_{suffix}",
            f"count({latency}) {here} AS latency_n_{suffix}",
            f"avg({latency}) {here} AS latency_mean_{suffix}",
            f"var_samp({latency}) {here} AS latency_var_{suffix}",
            f"count({x}) {here} AS x_n_{suffix}",
            f"avg({x}) {here} AS x_mean_{suffix}",
            f"var_samp({x}) {here} AS x_var_{suffix}",
            f"avg({y}) {here} AS y_mean_{suffix}",
            f"var_samp({y}) {here} AS y_var_{suffix}",
            f"covar_samp({y}, {x}) {here} AS xy_cov_{suffix}",
        ]
    either = "FILTER (WHERE variant IN ('control', 'treatment'))"
    measures += [
        f"avg({x}) {either} AS x_mean",
        f"var_samp({x}) {either} AS x_var",
        f"var_samp({y}) {either} AS y_var",
        f"covar_samp({y}, {x}) {either} AS xy_cov",
    ]
    return assignments.groupBy("experiment_id").agg(*map(F.expr, measures))
