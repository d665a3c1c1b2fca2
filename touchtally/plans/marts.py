"""The three marts: user journeys, channel ROI, experiment metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.config import DAYS_PER_MONTH, AttributionConfig
from touchtally.functions.columns import for_reading, guarded_ratio, rate
from touchtally.operators.journeys import build_touches, frequent_paths, journey_paths
from touchtally.operators.rules import attribution_facts

MARTS = ("mart_user_journeys", "mart_channel_roi", "mart_experiment_metrics")
_JOURNEY_COLUMNS = (
    "user_id", "path", "touch_count", "distinct_channels", "first_channel", "last_channel",
    "first_touch_ts", "last_touch_ts", "converted", "convert_ts", "revenue", "is_refunded", "net_revenue",
)


def calendar_mode(cfg: AttributionConfig) -> AttributionConfig:
    """The marts count the lookback in midnights."""
    return replace(cfg, lookback_mode="calendar")


def user_journeys(touches: DataFrame, conversions: DataFrame, cfg: AttributionConfig) -> DataFrame:
    cfg = calendar_mode(cfg)
    return journey_paths(build_touches(touches, conversions, cfg), cfg).select(*_JOURNEY_COLUMNS)


def channel_roi(
    touches: DataFrame, conversions: DataFrame, spend: DataFrame, cfg: AttributionConfig
) -> DataFrame:
    """Spend beside last-touch, first-touch and linear credit.

    A channel must appear on both sides.
    """
    cfg = calendar_mode(cfg)
    facts = attribution_facts(
        build_touches(touches, conversions, cfg), cfg, ["first_touch", "last_touch", "linear"]
    )
    credit = (
        facts.where(F.col("channel_mask").isNull())
        .groupBy(F.col("to_state").alias("channel"))
        .agg(
            F.sum("transitions").alias("touches"),
            F.coalesce(F.sum("credit_last_touch"), F.lit(0)).cast("long").alias("last_touch_conversions"),
            F.coalesce(F.sum("credit_first_touch"), F.lit(0)).cast("long").alias("first_touch_conversions"),
            F.coalesce(F.sum("credit_linear").cast("double"), F.lit(0.0)).alias("linear_conversions"),
        )
    )
    spent = spend.groupBy("channel").agg(
        F.sum("spend").alias("total_spend"),
        F.countDistinct("date").alias("days"),
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
    )
    return spent.join(credit, "channel").select(
        "channel", "total_spend",
        (F.col("total_spend") / (F.col("days") / F.lit(DAYS_PER_MONTH))).alias("monthly_spend"),
        "impressions", "clicks", "touches",
        "last_touch_conversions", "first_touch_conversions", "linear_conversions",
        guarded_ratio(F.col("total_spend"), F.col("last_touch_conversions")).alias("cac_last_touch"),
        guarded_ratio(F.col("total_spend"), F.col("linear_conversions")).alias("cac_linear"),
    )


def experiment_metrics(assignments: DataFrame) -> DataFrame:
    """Units, conversions and guardrails per arm, over all assigned units."""
    return assignments.groupBy("experiment_id", "variant").agg(
        F.count("*").alias("units"),
        F.sum("primary_metric").alias("conversions"),
        F.avg("primary_metric").alias("conversion_rate"),
        rate(F.col("guardrail_refund")).alias("refund_rate"),
        F.avg("guardrail_latency_ms").alias("mean_latency_ms"),
        F.avg("pre_covariate").alias("mean_pre_covariate"),
        F.min("assign_ts").alias("first_assigned"),
        F.max("assign_ts").alias("last_assigned"),
    )


def build_marts(
    spark: SparkSession,
    touches: DataFrame,
    conversions: DataFrame,
    spend: DataFrame,
    assignments: DataFrame,
    cfg: AttributionConfig,
) -> DataFrame:
    """Register the marts as temporary views and return their row counts.

    Views are planned anew at each read; calling this again replaces them.
    """
    frames = dict(zip(MARTS, (
        user_journeys(touches, conversions, cfg),
        channel_roi(touches, conversions, spend, cfg),
        experiment_metrics(assignments),
    )))
    counts = None
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
        count = spark.table(name).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("mart"), "row_count")
        counts = count if counts is None else counts.unionByName(count)
    return counts


def top_paths(touches: DataFrame, conversions: DataFrame, cfg: AttributionConfig, top_n: int = 5) -> DataFrame:
    """The most frequent converting paths of the journey mart, by their keys."""
    kept = build_touches(touches, conversions, calendar_mode(cfg))
    top = frequent_paths(kept, top_n, F.round(F.avg("touch_count"), 1).alias("mean_touches"))
    return top.select("path", "conversions", "mean_touches")


def channel_listing(channel_roi_mart: DataFrame) -> DataFrame:
    """Channel ROI rounded for reading, largest spend first."""
    return channel_roi_mart.select(
        "channel", for_reading("monthly_spend", 0).alias("monthly_spend"), "last_touch_conversions",
        for_reading("linear_conversions", 1).alias("linear_conversions"),
        for_reading("cac_last_touch", 2).alias("cac_last_touch"), for_reading("cac_linear", 2).alias("cac_linear"),
    ).orderBy(F.desc("monthly_spend"), "channel")
