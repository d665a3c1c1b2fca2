"""From assignments to a decision, for every experiment at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchtally.functions.columns import derive, guarded_ratio
from touchtally.functions.special import chi_square_sf, normal_sf
from touchtally.operators import bayes, estimators, guardrails, integrity
from touchtally.operators.moments import arm_moments
from touchtally.operators.sequential import with_plan

SHIP, DO_NOT_SHIP, KEEP_RUNNING = "SHIP", "DO NOT SHIP", "KEEP RUNNING"
INVALID = "INVALID — DO NOT INTERPRET"
GUARDRAILS = ("refund_rate", "latency_ms")

# Columns that exist only for experiments whose assignment can be trusted.
_EFFECT_PREFIXES = (
    *[f"{g}_" for g in GUARDRAILS], "guardrails_", "primary_", "raw_", "cuped_", "posterior_", "prob_",
    "expected_loss_", "lift_", "look_", "converter_",
)
_EFFECT_COLUMNS = (
    "theta", "correlation", "variance_reduction", "theoretical_reduction", "ci_width_reduction",
    "loss_tolerance", "ship_within_tolerance", "summary", "intervals_agree",
)


def with_ratio_check(df: DataFrame, alpha: float = integrity.INTEGRITY_ALPHA) -> DataFrame:
    """Sample-ratio test of the two arms on the moments row."""
    total = "(n_c + n_t)"
    gap = f"power(n_c - control_share * {total}, 2)"
    return derive(df, {
        "srm_chi_square":
            f"try_divide({gap}, control_share * {total}) + try_divide({gap}, (1 - control_share) * {total})",
        "srm_p_value": chi_square_sf(F.col("srm_chi_square"), F.lit(1.0)),
        "srm_passed": f"coalesce(srm_p_value >= {alpha}, false)",
    })


def with_guardrails(df: DataFrame) -> DataFrame:
    """Refund and latency guardrails, over all assigned units."""
    margin = "refund_margin_relative * try_divide(refunds_c, n_c)"
    df = guardrails.guardrail_proportion(df, "refund_rate", "refunds_c", "n_c", "refunds_t", "n_t", margin)
    df = guardrails.guardrail_mean(
        df, "latency_ms", ("latency_n_c", "latency_mean_c", "latency_var_c"),
        ("latency_n_t", "latency_mean_t", "latency_var_t"), "latency_margin",
    )
    return guardrails.guardrail_report(df, GUARDRAILS)


def with_current_look(df: DataFrame) -> DataFrame:
    """The planned boundary at the current look against the primary statistic."""
    return derive(df, {
        "look_boundary": "get(plan, current_look - 1).z_boundary",
        "look_crossed": "coalesce(abs(primary_statistic) >= look_boundary, false)",
        "look_is_final": "current_look >= size(looks)",
        "look_nominal_p": normal_sf(F.abs("primary_statistic")) * 2,
    })


def decide(df: DataFrame) -> DataFrame:
    """Add ``decision`` and ``rationale``: the gates in order, each with its reason.

    Validity, harm, a missing primary metric, the sequential boundary before the
    last look, then the interval against the practical threshold.
    """
    interval = "format_string('[%+.4f, %+.4f]', primary_ci_low, primary_ci_high)"
    bar = "format_string('threshold %+.4f.', practical_threshold)"
    start = "'Integrity and guardrails passed.'"
    # Condition, decision and reasons of each gate; the first that holds decides.
    gates = [
        ("NOT integrity_passed", f"'{INVALID}'", "array('Integrity failed: the effect is withheld.')"),
        ("NOT guardrails_passed", f"'{DO_NOT_SHIP}'",
         "array('Integrity passed.', concat('Guardrails not cleared: ', array_join(guardrails_blocking, ', '), '.'))"),
        ("primary_ci_low IS NULL", f"'{KEEP_RUNNING}'", f"array({start}, 'No primary metric.')"),
        ("NOT look_crossed AND NOT look_is_final", f"'{KEEP_RUNNING}'",
         f"array({start}, format_string('Look %d: |z| %.2f is below the boundary %.2f.', current_look,"
         " abs(primary_statistic), look_boundary))"),
        ("primary_ci_low > practical_threshold", f"'{SHIP}'",
         f"array({start}, concat('The interval ', {interval}, ' lies above the ', {bar}))"),
        ("primary_ci_high < practical_threshold", f"'{DO_NOT_SHIP}'",
         f"array({start}, concat('The interval ', {interval}, ' lies below the ', {bar}))"),
        ("look_is_final", f"'{DO_NOT_SHIP}'",
         f"array({start}, concat('The interval ', {interval}, ' straddles the ', {bar}), 'No further look is planned.')"),
        ("true", f"'{KEEP_RUNNING}'",
         f"array({start}, concat('The interval ', {interval}, ' straddles the ', {bar}), 'More data may separate them.')"),
    ]
    return derive(df, {
        "decision": "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then, _ in gates) + " END",
        "rationale": "CASE " + " ".join(f"WHEN {when} THEN {why}" for when, _, why in gates) + " END",
    })


def readout(assignments: DataFrame, config: DataFrame) -> DataFrame:
    """One row per configured experiment, with its decision.

    The assignment table is aggregated once. Every effect column is NULL for an
    experiment that fails integrity.
    """
    counts = ("n_c", "n_t", "refunds_c", "refunds_t", "converters_c", "converters_t",
              "converter_refunds_c", "converter_refunds_t")
    sums = ("conversions_c", "conversions_t")
    df = with_plan(config).join(arm_moments(assignments), "experiment_id", "left").fillna(
        {**{c: 0 for c in counts}, **{c: 0.0 for c in sums}}
    )
    df = derive(integrity.covariate_balance(with_ratio_check(df)), {
        "integrity_passed": "srm_passed AND coalesce(balance_passed, false)"
    })
    df = with_guardrails(df)
    df = estimators.two_proportion_test(df, "conversions_c", "n_c", "conversions_t", "n_t", "alpha", "primary_")
    df = estimators.cuped_two_sample(df, "alpha")
    df = bayes.beta_binomial_test(
        df, "conversions_c", "n_c", "conversions_t", "n_t", "practical_threshold", "1 - alpha"
    )
    df = bayes.decision_summary(df)
    df = derive(with_current_look(df), {
        "intervals_agree": "(primary_ci_low > practical_threshold) = (prob_exceeds_threshold >= 1 - alpha)"
    })
    df = decide(df)
    hidden = [c for c in df.columns if c.startswith(_EFFECT_PREFIXES) or c in _EFFECT_COLUMNS]
    arm_sums = [
        c for c in df.columns
        if c.endswith(("_c", "_t")) and c not in hidden and c not in ("n_c", "n_t", "x_n_c", "x_n_t")
    ]
    moments_only = {*arm_sums, "x_mean", "x_var", "y_var", "xy_cov", "plan"}
    return df.selectExpr(*[
        f"IF(integrity_passed, {c}, NULL) AS {c}" if c in hidden else c
        for c in df.columns if c not in moments_only
    ])


def guardrail_table(readout_rows: DataFrame) -> DataFrame:
    """One row per experiment and guardrail; values are withheld with the readout's."""
    return guardrails.guardrail_rows(readout_rows, GUARDRAILS)


def coverage(readout_rows: DataFrame, true_effects: DataFrame) -> DataFrame:
    """Whether a known effect (experiment_id, true_effect) lies in both intervals."""
    true = F.col("true_effect")
    return readout_rows.join(true_effects, "experiment_id").select(
        "experiment_id", "true_effect",
        true.between(F.col("primary_ci_low"), F.col("primary_ci_high")).alias("in_confidence_interval"),
        true.between(F.col("lift_ci_low"), F.col("lift_ci_high")).alias("in_credible_interval"),
    )


def refund_denominators(moments: DataFrame) -> DataFrame:
    """Resolvable refund margin over all units and over converters only."""
    def margin(events: str, units: str) -> Column:
        e_c, e_t, n_c, n_t = (F.col(f"{k}_{a}") for k in (events, units) for a in ("c", "t"))
        return guardrails.minimum_resolvable_margin(guarded_ratio(e_c + e_t, n_c + n_t), n_c, n_t)

    return moments.select(
        "experiment_id",
        margin("refunds", "n").alias("margin_all_units"),
        margin("converter_refunds", "converters").alias("margin_converters"),
    ).withColumn("precision_ratio", guarded_ratio(F.col("margin_converters"), F.col("margin_all_units")))
