from datetime import datetime

import pytest
from pyspark.sql import functions as F

from touchtally.plans import readout as ro
from touchtally.sources.tables import experiment_config


def population(spark, experiment, n_c=4000, n_t=4000, x_c=400, x_t=400, refunds_c=40, refunds_t=40,
               latency_t=0.0, covariate_t=0.0):
    """Units with exact counts per arm, built on the executors."""
    def arm(variant, n, x, refunds, latency, covariate):
        i = F.col("id")
        return spark.range(n).select(
            i.alias("user_id"), F.lit(experiment).alias("experiment_id"), F.lit(variant).alias("variant"),
            F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz").alias("assign_ts"),
            (i % 10 + covariate).cast("double").alias("pre_covariate"),
            (i < x).cast("double").alias("primary_metric"), (i < refunds).alias("guardrail_refund"),
            (200 + i % 7 + latency).cast("double").alias("guardrail_latency_ms"),
        )

    return arm("control", n_c, x_c, refunds_c, 0, 0).unionByName(arm("treatment", n_t, x_t, refunds_t, latency_t, covariate_t))


CASES = {
    "wins": (dict(x_t=560), dict(), ro.SHIP),
    "loses": (dict(x_t=350), dict(), ro.DO_NOT_SHIP),
    "straddles_at_end": (dict(x_t=440), dict(), ro.DO_NOT_SHIP),
    "straddles_early": (dict(x_t=470), dict(current_look=4, looks=[0.1, 0.2, 0.3, 0.99, 1.0]), ro.KEEP_RUNNING),
    "below_boundary": (dict(x_t=480), dict(current_look=1), ro.KEEP_RUNNING),
    "crossed_early": (dict(x_t=700), dict(current_look=2), ro.SHIP),
    "slow": (dict(x_t=560, latency_t=30.0), dict(), ro.DO_NOT_SHIP),
    "refunds": (dict(x_t=560, refunds_t=160), dict(), ro.DO_NOT_SHIP),
    "no_refunds": (dict(x_t=560, refunds_c=0), dict(), ro.DO_NOT_SHIP),
    "lost_units": (dict(n_t=3600, x_t=560), dict(), ro.INVALID),
    "unbalanced": (dict(x_t=560, covariate_t=3.0), dict(), ro.INVALID),
}


@pytest.fixture(scope="module")
def rows(spark):
    frames, settings = None, [{"experiment_id": "unseen", "salt": "s", "practical_threshold": 0.005}]
    for name, (shape, extra, _) in CASES.items():
        one = population(spark, name, **shape)
        frames = one if frames is None else frames.unionByName(one)
        settings.append({"experiment_id": name, "salt": "s", "practical_threshold": 0.005, **extra})
    result = ro.readout(frames, experiment_config(spark, settings)).cache()
    return {r.experiment_id: r for r in result.collect()}, result


@pytest.mark.parametrize("name", list(CASES))
def test_decision(rows, name):
    assert rows[0][name].decision == CASES[name][2], rows[0][name].rationale
    assert rows[0][name].rationale


def test_reasons_name_the_gate(rows):
    got = rows[0]
    assert "latency_ms (FAIL)" in got["slow"].rationale[-1]
    assert "refund_rate" in got["refunds"].rationale[-1]
    assert "above the threshold" in got["wins"].rationale[-1]
    assert "below the boundary" in got["below_boundary"].rationale[-1]
    assert "More data" in got["straddles_early"].rationale[-1]
    assert "No further look" in got["straddles_at_end"].rationale[-1]


def test_zero_base_refunds_do_not_stop_the_job(rows):
    row = rows[0]["no_refunds"]
    assert row.refund_rate_verdict == "INCONCLUSIVE" and row.refund_rate_error == "margin must be positive"


def test_missing_experiment_is_invalid_not_lost(rows):
    row = rows[0]["unseen"]
    assert row.n_c == 0 and row.decision == ro.INVALID


def test_effects_are_withheld_when_invalid(rows):
    allowed = {
        "experiment_id", "salt", "control_share", "practical_threshold", "alpha", "refund_margin_relative",
        "latency_margin", "looks", "spending", "current_look", "n_c", "n_t", "x_n_c", "x_n_t", "srm_chi_square",
        "srm_p_value", "srm_passed", "balance_error", "balance_control_mean", "balance_treatment_mean",
        "balance_standardised_difference", "balance_p_value", "balance_passed", "integrity_passed", "decision",
        "rationale",
    }
    for name in ("lost_units", "unbalanced", "unseen"):
        shown = {k for k, v in rows[0][name].asDict().items() if v is not None}
        assert shown <= allowed, shown - allowed
    table = ro.guardrail_table(rows[1]).where("experiment_id in ('lost_units', 'unbalanced')")
    assert table.where("harm is not null or verdict is not null").count() == 0


def test_threshold_flips_the_decision(spark):
    data = population(spark, "e", x_t=560)
    for threshold, expected in ((0.005, ro.SHIP), (0.08, ro.DO_NOT_SHIP)):
        config = experiment_config(spark, [{"experiment_id": "e", "salt": "s", "practical_threshold": threshold}])
        assert ro.readout(data, config).first().decision == expected


def test_interval_agreement_and_coverage(spark, rows):
    got = rows[0]
    assert got["wins"].intervals_agree and got["loses"].intervals_agree
    truth = spark.createDataFrame([("wins", 0.04), ("loses", 0.2)], "experiment_id string, true_effect double")
    inside = {r.experiment_id: r for r in ro.coverage(rows[1], truth).collect()}
    assert inside["wins"].in_confidence_interval and inside["wins"].in_credible_interval
    assert not inside["loses"].in_confidence_interval


def test_converter_denominator_is_less_precise(spark):
    from touchtally.operators.moments import arm_moments

    row = ro.refund_denominators(arm_moments(population(spark, "e"))).first()
    assert row.precision_ratio > 5


