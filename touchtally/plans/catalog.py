"""Named queries over the test tables, one per operator.

Doubles are rounded so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchtally.config import RULE_MODELS, AttributionConfig
from touchtally.functions.columns import (
    bucket_hash,
    calendar_days,
    clip,
    for_reading,
    half_life_weight,
    net_of_refund,
    rate,
)
from touchtally.operators import (
    assignment,
    bayes,
    design,
    estimators,
    guardrails,
    integrity,
    journeys,
    markov,
    moments,
    rules,
    sequential,
    shapley,
    value,
)
from touchtally.plans import marts
from touchtally.plans import readout as readouts
from touchtally.plans.attribution import AttributionRun
from touchtally.sources import bridge, tables

Query = Callable[[SparkSession, str], DataFrame]

CFG = AttributionConfig(channels=bridge.CHANNELS)
# A lookback short enough to cut the test journeys, which last a day.
SHORT = replace(CFG, lookback_days=0.25)

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, with -0.0 turned into 0.0; first finer, so that what is a tie but for the last bits goes up as a tie."""
    return for_reading(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        r(F.col(name), digits).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes
    ])


def _source(spark: SparkSession, sf: str, cfg: AttributionConfig = CFG) -> journeys.JourneyTouches:
    return journeys.journey_source(bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), cfg)


def _kept(spark: SparkSession, sf: str, cfg: AttributionConfig = CFG) -> journeys.JourneyTouches:
    return journeys.within_lookback(_source(spark, sf, cfg), cfg)


def _facts(spark: SparkSession, sf: str, cfg: AttributionConfig = CFG, models=RULE_MODELS) -> DataFrame:
    return rules.attribution_facts(_kept(spark, sf, cfg), cfg, models)


def _run(spark: SparkSession, sf: str, cfg: AttributionConfig = SHORT) -> AttributionRun:
    return AttributionRun.start(bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), cfg)


def _weekday_touches(spark: SparkSession, sf: str) -> DataFrame:
    """Touches with a segment; the journey unit is a day, so it is constant per unit."""
    return bridge.touchpoints(spark, sf).withColumn(
        "day_kind", F.when(F.dayofweek("ts").isin(1, 7), "weekend").otherwise("weekday")
    )


def _experiments(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.experiment_assignment(spark, sf)


def _with_config(spark: SparkSession, sf: str) -> DataFrame:
    """The moments row of each experiment beside its settings."""
    return bridge.config(spark).join(moments.arm_moments(_experiments(spark, sf)), "experiment_id")


# --- sources ----------------------------------------------------------------------


@query
def S1_raw_scans(spark: SparkSession, sf: str) -> DataFrame:
    counts = None
    for name, frame, key in (
        ("users", bridge.users(spark, sf), "user_id"),
        ("touchpoints", bridge.touchpoints(spark, sf), "touch_id"),
        ("conversions", bridge.conversions(spark, sf), "conversion_id"),
        ("spend", bridge.spend(spark, sf), "campaign"),
        ("experiment_assignment", _experiments(spark, sf), "user_id"),
    ):
        one = frame.agg(F.count("*").alias("row_count"), F.countDistinct(key).alias("distinct_keys")).select(
            F.lit(name).alias("table_name"), "row_count", "distinct_keys"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def S2_J1_journey_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = _source(spark, sf).rows()
    return rows.select(
        "user_id", "touch_id", "channel", "ts", "converted", "convert_ts", r("revenue").alias("revenue"),
        "is_refunded", r("age_days", 9).alias("age_days"),
    )


@query
def S3_load_experiment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tables.load_experiment(_experiments(spark, sf), "exp_a"))


@query
def S3_missing_experiments(spark: SparkSession, sf: str) -> DataFrame:
    config = tables.experiment_config(spark, [
        *bridge.EXPERIMENTS, {"experiment_id": "exp_unused", "salt": "salt-u", "practical_threshold": 0.01},
    ])
    return tables.missing_experiments(_experiments(spark, sf), config)


@query
def S6_mart_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return marts.build_marts(
        spark, bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), bridge.spend(spark, sf),
        _experiments(spark, sf), SHORT,
    )


# --- scalar primitives, aggregates, windows ----------------------------------------


@query
def F_E_touch_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """Window predicate, null defaults, net revenue, day ages and decay, per touch."""
    age = F.col("age_days")
    days = calendar_days(F.col("ts"), F.col("convert_ts"))
    return _source(spark, sf).rows().select(
        "user_id", "touch_id", days.cast("double").alias("calendar_days"), r(age, 9).alias("age_days"),
        r(half_life_weight(age, 7.0), 9).alias("decay"),
        (F.col("convert_ts").isNull() | ((age >= 0) & (age <= 0.25))).alias("inside"),
        r(net_of_refund(F.col("revenue"), F.col("is_refunded"))).alias("net_revenue"),
        r(clip(F.col("revenue"), F.lit(5.0), F.lit(50.0))).alias("clipped_revenue"),
        F.signum(F.coalesce(age, F.lit(0.0))).alias("age_sign"),
    )


@query
def E3_E4_X1_bucket_hash(spark: SparkSession, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return customers.select("user_id", *[
        bucket_hash(F.col("user_id"), e["salt"]).alias(e["experiment_id"]) for e in bridge.EXPERIMENTS
    ])


@query
def A_channel_profile(spark: SparkSession, sf: str) -> DataFrame:
    touches = bridge.touchpoints(spark, sf)
    second = F.second("ts").cast("double")
    return touches.groupBy("channel").agg(
        F.count("*").alias("touches"), F.countDistinct("user_id").alias("users"),
        F.countDistinct(F.to_date("ts")).alias("days"),
        r(F.sum("cost_attributed"), 4).alias("cost"), r(F.avg("cost_attributed")).alias("mean_cost"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        r(F.var_samp("cost_attributed")).alias("cost_variance"),
        r(F.covar_samp("cost_attributed", second)).alias("cost_second_covariance"),
        r(F.corr("cost_attributed", second)).alias("cost_second_correlation"),
        F.bool_or(F.col("cost_attributed") > 60).alias("has_costly"),
        r(rate(F.col("cost_attributed") > 20)).alias("costly_rate"),
        r(F.sum(F.when(F.dayofweek("ts").isin(1, 7), F.col("cost_attributed"))), 4).alias("weekend_cost"),
    )


@query
def W_touch_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = journeys.touch_positions(_kept(spark, sf, SHORT), SHORT)
    return rows.select(
        "user_id", "touch_id", "pos_asc", "pos_desc", "touches", r("decay_total", 9).alias("decay_total")
    )


# --- journeys ----------------------------------------------------------------------


@query
def J0_conversion_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journeys.conversion_rollup(bridge.conversions(spark, sf)))


@query
def J2_F2_attribution_window(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, SHORT).rows().select(
        "user_id", "touch_id", "channel", "converted", r("age_days", 9).alias("age_days")
    )


@query
def J3_touch_quality(spark: SparkSession, sf: str) -> DataFrame:
    return journeys.touch_quality(bridge.touchpoints(spark, sf), ("click", "signup", "view"))


@query
def J4_journeys(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journeys.journeys(_kept(spark, sf, SHORT), SHORT)).select(
        "user_id", "touches", "distinct_channels", "first_channel", "last_channel", "first_ts", "last_ts",
        "converted", "convert_ts", "revenue", "is_refunded", "net_revenue", "decay_total",
    )


@query
def J5_paths(spark: SparkSession, sf: str) -> DataFrame:
    return journeys.journey_paths(_kept(spark, sf), CFG).select("user_id", "path", "touch_count")


@query
def J5_path_segments(spark: SparkSession, sf: str) -> DataFrame:
    return journeys.path_segments(_kept(spark, sf, SHORT)).select(
        "user_id", "slice", "touches", F.array_join("channels", " > ").alias("path")
    )


@query
def J6_days_to_conversion(spark: SparkSession, sf: str) -> DataFrame:
    kept = _kept(spark, sf).rows().where("converted")
    return kept.groupBy("channel").agg(
        F.count("age_days").alias("touches"), r(F.avg("age_days")).alias("mean_days"),
        r(F.max("age_days")).alias("max_days"),
    )


@query
def J7_journey_counts(spark: SparkSession, sf: str) -> DataFrame:
    return journeys.journey_counts(journeys.journeys(_kept(spark, sf, SHORT), SHORT))


@query
def J8_T2_path_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journeys.path_summary(_kept(spark, sf), 10), 4)


@query
def J9_distinct_channels(spark: SparkSession, sf: str) -> DataFrame:
    return journeys.distinct_channel_counts(journeys.journeys(_kept(spark, sf), CFG))


# --- rule credit ---------------------------------------------------------------------


@query
def R0_touch_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighted = rules.touch_weights(journeys.touch_positions(_kept(spark, sf), CFG), CFG)
    return weighted.select(
        "user_id", "touch_id", *[r(f"weight_{m}", 9).alias(f"weight_{m}") for m in RULE_MODELS]
    )


def _one_rule(model: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        facts = _facts(spark, sf, SHORT, [model])
        return rounded(rules.credit_by_channel(facts, SHORT, [model]), 4).drop("model")

    return run


for _number, _model in enumerate(RULE_MODELS, 1):
    QUERIES[f"R{_number}_{_model}"] = _one_rule(_model)


@query
def R6_credit_by_channel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rules.credit_by_channel(_facts(spark, sf), CFG), 4)


@query
def R7_credit_table(spark: SparkSession, sf: str) -> DataFrame:
    shares = rules.credit_shares(rules.credit_by_channel(_facts(spark, sf), CFG))
    return rounded(rules.pivot_models(shares, "share", RULE_MODELS))


@query
def R7_conservation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rules.conservation(_facts(spark, sf, SHORT)))


@query
def R8_revenue_credit_table(spark: SparkSession, sf: str) -> DataFrame:
    credit = rules.credit_by_channel(_facts(spark, sf), CFG)
    return rounded(rules.pivot_models(credit, "revenue", RULE_MODELS), 4)


# --- data-driven credit ----------------------------------------------------------------


@query
def D1_transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(markov.transition_matrix(_facts(spark, sf, CFG, []), CFG.channels))


@query
def D2_absorption(spark: SparkSession, sf: str) -> DataFrame:
    matrix = markov.transition_matrix(_facts(spark, sf, SHORT, []), SHORT.channels)
    return rounded(markov.absorption_probabilities(matrix, SHORT.channels))


@query
def D3_markov(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(markov.markov_attribution(_facts(spark, sf, SHORT, []), SHORT.channels))


@query
def D3_markov_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    segments = ["day_kind"]
    kept = journeys.build_touches(_weekday_touches(spark, sf), bridge.conversions(spark, sf), SHORT, segments)
    facts = rules.attribution_facts(kept, SHORT, [])
    return rounded(markov.markov_attribution(facts, SHORT.channels, segments))


@query
def D4_D7_coalition_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(shapley.coalition_values(_facts(spark, sf, SHORT, []), SHORT.channels))


@query
def D5_shapley(spark: SparkSession, sf: str) -> DataFrame:
    values = shapley.coalition_values(_facts(spark, sf, SHORT, []), SHORT.channels)
    return rounded(shapley.shapley_attribution(values, SHORT.channels)).drop("reason")


@query
def D5_shapley_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    segments = ["day_kind"]
    kept = journeys.build_touches(_weekday_touches(spark, sf), bridge.conversions(spark, sf), SHORT, segments)
    values = shapley.coalition_values(rules.attribution_facts(kept, SHORT, []), SHORT.channels, segments)
    return rounded(shapley.shapley_attribution(values, SHORT.channels, segments)).drop("reason")


@query
def D4_D5_declared_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Shapley over campaigns: 30 declared, of which the log has twelve."""
    touches = bridge.touchpoints(spark, sf).withColumn("channel", F.col("campaign"))
    declared = tuple(f"{c}_cmp_{i}" for c in (*bridge.CHANNELS, "affiliate", "partner") for i in range(5))
    cfg = replace(SHORT, channels=declared)
    facts = rules.attribution_facts(journeys.build_touches(touches, bridge.conversions(spark, sf), cfg), cfg, [])
    return rounded(shapley.shapley_credit(facts, declared)).drop("reason")


@query
def D6_efficiency_residual(spark: SparkSession, sf: str) -> DataFrame:
    run = _run(spark, sf)
    values = shapley.coalition_values(run.facts, SHORT.channels)
    phi = shapley.shapley_attribution(values, SHORT.channels)
    return rounded(shapley.efficiency_residual(phi, values, SHORT.channels), 9)


# --- value ---------------------------------------------------------------------------


@query
def V1_channel_spend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(value.channel_spend(bridge.spend(spark, sf), CFG.channels), 4)


@query
def V2_net_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(journeys.journeys(_kept(spark, sf), CFG).where("converted"), 4).select(
        "user_id", "revenue", "is_refunded", "net_revenue"
    )


@query
def V3_credited_value(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_run(spark, sf).credited_value(), 4)


@query
def V4_roi_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_run(spark, sf).roi(bridge.spend(spark, sf)), 4).drop("reason")


def _segment_run(spark: SparkSession, sf: str) -> AttributionRun:
    return AttributionRun.start(_weekday_touches(spark, sf), bridge.conversions(spark, sf), SHORT, ["day_kind"])


def _segment_spend(spark: SparkSession, sf: str) -> DataFrame:
    weekend = F.dayofweek("date").isin(1, 7)
    return bridge.spend(spark, sf).withColumn("day_kind", F.when(weekend, "weekend").otherwise("weekday"))


@query
def V4_roi_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_segment_run(spark, sf).roi(_segment_spend(spark, sf)), 4)


@query
def V5_reallocation_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_segment_run(spark, sf).reallocation(_segment_spend(spark, sf)), 4)


@query
def V6_misallocation_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_segment_run(spark, sf).misallocation(_segment_spend(spark, sf)), 4)


@query
def V7_attribution_matrix_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_segment_run(spark, sf).attribution_matrix())


@query
def V8_recovery_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_segment_run(spark, sf).recovery(bridge.truth(spark)))


@query
def V5_reallocation_plan(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_run(spark, sf).reallocation(bridge.spend(spark, sf)), 4).drop("reason")


@query
def V5_reallocation_summary(spark: SparkSession, sf: str) -> DataFrame:
    roi = _run(spark, sf).roi(bridge.spend(spark, sf), ["last_touch", "linear", "shapley"])
    return rounded(value.reallocation_summary(value.reallocation_plan(roi, 0.05)), 4)


@query
def V6_misallocation(spark: SparkSession, sf: str) -> DataFrame:
    roi = _run(spark, sf).roi(bridge.spend(spark, sf), ["last_touch", "shapley"])
    return rounded(value.misallocation(roi), 4)


@query
def V7_attribution_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_run(spark, sf).attribution_matrix())


@query
def V8_T3_recovery_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_run(spark, sf).recovery(bridge.truth(spark))).drop("reason")


@query
def V9_comparison_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(value.shares_against_truth(_run(spark, sf).shares(), bridge.truth(spark)))


# --- marts -----------------------------------------------------------------------------


@query
def M0_calendar_window(spark: SparkSession, sf: str) -> DataFrame:
    cfg = marts.calendar_mode(replace(CFG, lookback_days=0.0))
    return _kept(spark, sf, cfg).rows().select("user_id", "touch_id", "channel", "converted")


@query
def M1_mart_user_journeys(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(marts.user_journeys(bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), CFG))


@query
def M2_mart_channel_roi(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(marts.channel_roi(
        bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), bridge.spend(spark, sf), CFG
    ), 4)


@query
def M3_mart_experiment_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(marts.experiment_metrics(_experiments(spark, sf)), 4)


@query
def M4_top_paths(spark: SparkSession, sf: str) -> DataFrame:
    return marts.top_paths(bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), CFG, 5)


@query
def M4_channel_listing(spark: SparkSession, sf: str) -> DataFrame:
    return marts.channel_listing(marts.channel_roi(
        bridge.touchpoints(spark, sf), bridge.conversions(spark, sf), bridge.spend(spark, sf), CFG
    ))


# --- assignment and integrity --------------------------------------------------------------


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"))


@query
def X2_assign(spark: SparkSession, sf: str) -> DataFrame:
    return assignment.assign(_customers(spark, sf), "salt-a", 0.3).select("user_id", "variant")


@query
def X3_assign_multivariate(spark: SparkSession, sf: str) -> DataFrame:
    arms = [("control", 0.5), ("short", 0.2), ("long", 0.3)]
    return assignment.assign_multivariate(_customers(spark, sf), "salt-m", arms).select("user_id", "variant")


@query
def X4_observed_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assignment.observed_split(_experiments(spark, sf)))


@query
def X5_X9_srm_check(spark: SparkSession, sf: str) -> DataFrame:
    expected = integrity.expected_arms(bridge.config(spark))
    return rounded(integrity.srm_check(_experiments(spark, sf), expected)).drop("error")


@query
def X5_srm_three_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Three hashed arms checked against shares that are not theirs."""
    arms = [("control", 0.5), ("short", 0.2), ("long", 0.3)]
    rows = assignment.assign_multivariate(_customers(spark, sf), "salt-m", arms).withColumn(
        "experiment_id", F.lit("exp_m")
    )
    expected = spark.createDataFrame(
        [("exp_m", "control", 2.0), ("exp_m", "long", 1.0), ("exp_m", "short", 1.0)],
        "experiment_id string, variant string, weight double",
    )
    return rounded(integrity.srm_check(rows, expected)).select(
        "experiment_id", "total_units", "arms", "chi_square", "degrees_of_freedom", "p_value", "passed",
        "worst_variant", "worst_delta_units",
    )


@query
def X6_covariate_balance(spark: SparkSession, sf: str) -> DataFrame:
    tested = integrity.covariate_balance(moments.arm_moments(_experiments(spark, sf)))
    return tested.select(
        "experiment_id", r("balance_control_mean", 4).alias("control_mean"),
        r("balance_treatment_mean", 4).alias("treatment_mean"),
        r("balance_standardised_difference").alias("standardised_difference"),
        r("balance_p_value").alias("p_value"), F.col("balance_passed").alias("passed"),
    )


@query
def X7_duplicate_units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as repeated assignments of their customer."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderpriority").alias("experiment_id"), F.col("o_custkey").alias("user_id")
    )
    return integrity.duplicate_units(orders)


def _drifted(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments where the units of one segment were recorded the other way round."""
    building = spark.read.parquet(f"{sf}/customer.parquet").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("user_id"), F.lit(True).alias("flipped")
    )
    other = F.when(F.col("variant") == "control", "treatment").otherwise("control")
    return _experiments(spark, sf).join(building, "user_id", "left").withColumn(
        "variant", F.when(F.col("flipped"), other).otherwise(F.col("variant"))
    )


@query
def X8_reproducibility(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(integrity.assignment_reproducibility(_drifted(spark, sf), bridge.config(spark)))


@query
def X8_mismatched_units(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.mismatched_units(_drifted(spark, sf), bridge.config(spark))


# --- estimators --------------------------------------------------------------------------------


def _test_columns(prefix: str, extra: tuple[str, ...] = ()) -> list[Column]:
    names = (
        "control_mean", "treatment_mean", "absolute_effect", "relative_effect", "standard_error",
        "statistic", "p_value", "ci_low", "ci_high", *extra,
    )
    return [r(f"{prefix}{n}").alias(n) for n in names] + [F.col(f"{prefix}significant").alias("significant")]


@query
def X10_X12_two_proportion_test(spark: SparkSession, sf: str) -> DataFrame:
    df = estimators.two_proportion_test(
        _with_config(spark, sf), "conversions_c", "n_c", "conversions_t", "n_t", "alpha", "z_"
    )
    return df.select("experiment_id", *_test_columns("z_"))


@query
def X10_one_sided(spark: SparkSession, sf: str) -> DataFrame:
    df = estimators.two_proportion_test(
        _with_config(spark, sf), "refunds_c", "n_c", "refunds_t", "n_t", "alpha", "z_", two_sided=False
    )
    return df.select("experiment_id", *_test_columns("z_"))


@query
def X11_welch_test(spark: SparkSession, sf: str) -> DataFrame:
    df = estimators.welch_test(
        _with_config(spark, sf), ("latency_n_c", "latency_mean_c", "latency_var_c"),
        ("latency_n_t", "latency_mean_t", "latency_var_t"), "alpha", "t_",
    )
    return df.select("experiment_id", *_test_columns("t_", ("degrees_of_freedom",)))


@query
def X13_X15_cuped(spark: SparkSession, sf: str) -> DataFrame:
    df = estimators.cuped_two_sample(_with_config(spark, sf))
    return df.select(
        "experiment_id", r(F.col("theta") * 1e6).alias("theta_per_million"),
        r("correlation").alias("correlation"), r("variance_reduction", 9).alias("variance_reduction"),
        r("theoretical_reduction", 9).alias("theoretical_reduction"),
        r("ci_width_reduction", 8).alias("ci_width_reduction"),
        *[r(f"{k}_{n}").alias(f"{k}_{n}") for k in ("raw", "cuped")
          for n in ("absolute_effect", "standard_error", "statistic", "p_value", "ci_low", "ci_high")],
    )


@query
def X14_cuped_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _experiments(spark, sf)
    adjusted = estimators.cuped_adjusted_rows(rows, moments.arm_moments(rows))
    return adjusted.select("experiment_id", "user_id", "variant", r("adjusted_metric").alias("adjusted_metric"))


@query
def X16_posterior_comparison(spark: SparkSession, sf: str) -> DataFrame:
    df = bayes.beta_binomial_test(_with_config(spark, sf), "conversions_c", "n_c", "conversions_t", "n_t")
    names = (
        "posterior_a_c", "posterior_b_c", "posterior_mean_c", "posterior_a_t", "posterior_b_t",
        "posterior_mean_t", "prob_treatment_better", "prob_exceeds_threshold", "expected_loss_ship",
        "expected_loss_hold",
    )
    return df.select("experiment_id", *[r(n).alias(n) for n in names])


@query
def X16_lift_interval(spark: SparkSession, sf: str) -> DataFrame:
    df = bayes.beta_binomial_test(_with_config(spark, sf), "conversions_c", "n_c", "conversions_t", "n_t")
    names = ("lift_median", "lift_ci_low", "lift_ci_high")
    return df.select("experiment_id", *[r(n).alias(n) for n in names])


@query
def X17_decision_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = bayes.beta_binomial_test(_with_config(spark, sf), "conversions_c", "n_c", "conversions_t", "n_t")
    return bayes.decision_summary(df).select(
        "experiment_id", r("loss_tolerance").alias("loss_tolerance"), "ship_within_tolerance"
    )


# --- sequential ----------------------------------------------------------------------------------


@query
def X18_alpha_spending(spark: SparkSession, sf: str) -> DataFrame:
    """Alpha spent by the end of each assignment day, under three functions."""
    daily = _experiments(spark, sf).groupBy("experiment_id", F.to_date("assign_ts").alias("day")).agg(
        F.count("*").alias("units")
    )
    by_day = Window.partitionBy("experiment_id").orderBy(F.col("day").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy("experiment_id")
    t = F.sum("units").over(by_day) / F.sum("units").over(whole)
    df = daily.withColumn("t", t)
    return df.select("experiment_id", "day", r("t").alias("fraction"), *[
        r(sequential.spent_column(name, F.col("t"), F.lit(0.05))).alias(name) for name in sequential.SPENDING
    ])


@query
def X19_plan_alphas(spark: SparkSession, sf: str) -> DataFrame:
    """Look plans at the fractions that each experiment had reached by the ends of its months, under three functions."""
    month = F.date_trunc("month", F.col("assign_ts"))
    monthly = _experiments(spark, sf).groupBy("experiment_id", month.alias("month")).agg(F.count("*").alias("units"))
    so_far = Window.partitionBy("experiment_id").orderBy(F.col("month").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = monthly.withColumn("t", F.sum("units").over(so_far) / F.sum("units").over(Window.partitionBy("experiment_id")))
    # One list entry per month.
    measured = reached.groupBy("experiment_id").agg(F.array_sort(F.collect_set("t")).alias("looks")).withColumn("alpha", F.lit(0.05))
    plans = None
    for name in sequential.SPENDING:
        plan = sequential.look_plan(measured.withColumn("spending", F.lit(name))).select(
            F.lit(name).alias("spending"), "experiment_id", "look", r("information_fraction").alias("information_fraction"),
            r("cumulative_alpha").alias("cumulative_alpha"), r("incremental_alpha").alias("incremental_alpha"), "is_final",
        )
        plans = plan if plans is None else plans.unionByName(plan)
    return plans


@query
def X19_X20_interim_looks(spark: SparkSession, sf: str) -> DataFrame:
    looks = sequential.interim_looks(_experiments(spark, sf), bridge.config(spark))
    return looks.select(
        "experiment_id", "look", r("information_fraction").alias("information_fraction"), "reached_at", "n_c", "n_t",
        r("conversions_c").alias("conversions_c"), r("conversions_t").alias("conversions_t"), r("z").alias("z"),
        r("z_boundary", 2).alias("z_boundary"), r("nominal_p").alias("nominal_p"), "crossed", "stop",
    )


@query
def X20_sequential_decision(spark: SparkSession, sf: str) -> DataFrame:
    looks = sequential.interim_looks(_experiments(spark, sf), bridge.config(spark))
    return sequential.sequential_decision(looks).select(
        "experiment_id", "look", r("z").alias("z"), "crossed", "stop"
    )


@query
def X20_mean_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Looks at the mean of a metric that isn't a rate."""
    looks = sequential.mean_looks(_experiments(spark, sf), bridge.config(spark), "guardrail_latency_ms")
    return looks.select(
        "experiment_id", "look", r("information_fraction").alias("information_fraction"), "n_c", "n_t",
        r("mean_c").alias("mean_c"), r("mean_t").alias("mean_t"), r("z").alias("z"),
        r("z_boundary", 2).alias("z_boundary"), r("nominal_p").alias("nominal_p"), "crossed", "stop",
    )


@query
def X21_aa_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sequential.aa_audit(_experiments(spark, sf), bridge.config(spark)))


# --- guardrails and decision ------------------------------------------------------------------------


@query
def X22_X23_margins(spark: SparkSession, sf: str) -> DataFrame:
    df = _with_config(spark, sf).withColumn(
        "base_rate", (F.col("refunds_c") + F.col("refunds_t")) / (F.col("n_c") + F.col("n_t"))
    )
    return df.select(
        "experiment_id", r("base_rate").alias("base_rate"),
        r(guardrails.minimum_resolvable_margin("base_rate", "n_c", "n_t")).alias("resolvable_margin"),
        guardrails.required_n_for_margin("base_rate", F.lit(0.05)).alias("required_n"),
    )


@query
def X24_X27_guardrails(spark: SparkSession, sf: str) -> DataFrame:
    df = readouts.with_guardrails(_with_config(spark, sf))
    return rounded(guardrails.guardrail_rows(df, readouts.GUARDRAILS)).drop("error")


@query
def X27_guardrail_report(spark: SparkSession, sf: str) -> DataFrame:
    df = readouts.with_guardrails(_with_config(spark, sf))
    return df.select(
        "experiment_id", "guardrails_passed", F.array_join("guardrails_blocking", ",").alias("blocking"),
        F.array_join("guardrails_underpowered", ",").alias("underpowered"),
    )


@query
def X28_X29_readout(spark: SparkSession, sf: str) -> DataFrame:
    rows = readouts.readout(_experiments(spark, sf), bridge.config(spark))
    return rows.select(
        "experiment_id", "n_c", "n_t", r("srm_p_value").alias("srm_p_value"), "srm_passed", "balance_passed",
        "integrity_passed", "guardrails_passed", r("primary_absolute_effect").alias("effect"),
        r("primary_p_value").alias("p_value"), r("primary_ci_low").alias("ci_low"),
        r("primary_ci_high").alias("ci_high"), r("cuped_absolute_effect").alias("cuped_effect"),
        r("prob_treatment_better").alias("prob_treatment_better"), "look_crossed", "decision",
    )


@query
def X29_readout_of_broken_split(spark: SparkSession, sf: str) -> DataFrame:
    """Treated units without orders in the period were lost: effects are withheld."""
    broken = _experiments(spark, sf).where(
        ~((F.col("variant") == "treatment") & (F.col("primary_metric") == 0))
    )
    rows = readouts.readout(broken, bridge.config(spark))
    return rows.select(
        "experiment_id", "n_c", "n_t", r("srm_chi_square", 4).alias("srm_chi_square"), "srm_passed",
        "integrity_passed", r("primary_absolute_effect").alias("effect"),
        r("prob_treatment_better").alias("prob_treatment_better"), "refund_rate_verdict", "decision",
    )


@query
def X30_agreement_and_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = readouts.readout(_experiments(spark, sf), bridge.config(spark))
    # The split is random and nothing was treated, so the true effect is 0.
    truth = bridge.config(spark).select("experiment_id", F.lit(0.0).alias("true_effect"))
    return readouts.coverage(rows, truth).join(rows.select("experiment_id", "intervals_agree"), "experiment_id").select(
        "experiment_id", "in_confidence_interval", "in_credible_interval", "intervals_agree"
    )


@query
def X31_refund_denominators(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(readouts.refund_denominators(moments.arm_moments(_experiments(spark, sf))))


# --- design -------------------------------------------------------------------------------------------


@query
def P1_P6_design_table(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_totalprice", "o_orderdate")
    segment = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    history = orders.join(segment, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("segment"),
        (F.col("o_totalprice") > 200000).cast("double").alias("metric"),
        F.col("o_totalprice").alias("amount"), F.col("c_acctbal").alias("covariate"),
        F.to_date("o_orderdate").alias("day"),
    )
    return rounded(design.design_table(history, ["segment"], mde=0.02, mean_mde=5000.0))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """ROI of every channel under all seven models."""
    return V4_roi_table(spark, sf)
