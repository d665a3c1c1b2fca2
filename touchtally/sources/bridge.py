"""The model's tables derived from the TPC-H-like test tables.

The journey unit is a user on a day, so that journeys without a conversion exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.functions.columns import bucket_hash
from touchtally.sources.tables import conform, experiment_config

# Fixed values of the bridge.
CHANNELS = ("click", "error", "signup", "view")
TRUE_SHARES = {"click": 0.4, "error": 0.1, "signup": 0.3, "view": 0.2}
EXPERIMENTS = (
    {"experiment_id": "exp_a", "salt": "salt-a", "practical_threshold": 0.005, "latency_margin": 1.0},
    {"experiment_id": "exp_b", "salt": "salt-b", "practical_threshold": 0.005, "latency_margin": 1.0},
)
PERIOD_START = "1999-01-01"
METRIC_START = "2001-01-01"


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text} 00:00:00'")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", "value",
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("unit_id"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )


def touchpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where(F.col("event_type") != "purchase")
    campaign = F.concat("event_type", F.lit("_cmp_"), (F.col("k") % 3 + 1).cast("string"))
    return conform(
        rows.select(
            F.col("event_id").alias("touch_id"), F.col("unit_id").alias("user_id"),
            F.col("event_type").alias("channel"), campaign.alias("campaign"), "ts",
            F.col("value").alias("cost_attributed"),
        ),
        "touchpoints",
        ["touch_id", "user_id", "channel", "ts"],
    )


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return conform(
        rows.select(
            F.col("event_id").alias("conversion_id"), F.col("unit_id").alias("user_id"),
            F.col("ts").alias("convert_ts"), F.col("value").alias("revenue"),
            (F.col("k") >= 90).alias("is_refunded"),
        ),
        "conversions",
        ["conversion_id", "user_id", "convert_ts", "revenue", "is_refunded"],
    )


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend per day, channel and campaign."""
    rows = _events(spark, sf_dir).where(F.col("event_type") != "purchase")
    campaign = F.concat("event_type", F.lit("_cmp_"), (F.col("k") % 3 + 1).cast("string"))
    return conform(
        rows.groupBy(
            F.to_date("ts").alias("date"), F.col("event_type").alias("channel"), campaign.alias("campaign")
        ).agg(
            F.sum("value").alias("spend"),
            F.count("*").alias("impressions"),
            F.count_if(F.col("k") < 50).alias("clicks"),
        ),
        "spend",
    )


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRUE_SHARES.items()), "channel string, true_share double")


def config(spark: SparkSession) -> DataFrame:
    return experiment_config(spark, list(EXPERIMENTS))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: market segment stands for the platform, nation for the country."""
    nation = _load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    first_order = _load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("signup_ts"))
    return conform(
        _load(spark, sf_dir, "customer")
        .join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("user_id"), "signup_ts",
            F.col("c_mktsegment").alias("platform"), F.col("n_name").alias("country"),
            F.date_format("signup_ts", "yyyy-MM").alias("acquisition_cohort"),
        ),
        "users",
    )


def experiment_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in two experiments with metrics from their orders."""
    orders = _load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    in_period = F.col("o_orderdate") >= _ntz(METRIC_START)
    per_customer = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min("o_orderdate").alias("assign_ts"),
        F.avg(F.when(F.col("o_orderdate") < _ntz(PERIOD_START), F.col("o_totalprice"))).alias("pre_covariate"),
        F.max(F.when(in_period, F.lit(1.0)).otherwise(F.lit(0.0))).alias("primary_metric"),
    )
    lines = _load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    # Lines are folded per order first, so that the join moves one row per order.
    per_order = lines.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"),
        F.count("l_quantity").alias("quantities"),
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
    )
    line_facts = (
        orders.where(in_period)
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"))
        .agg(
            F.bool_or("returned").alias("guardrail_refund"),
            (F.sum("quantity") / F.sum("quantities")).alias("guardrail_latency_ms"),
        )
    )
    arms = F.explode(F.array(*[
        F.struct(F.lit(e["experiment_id"]).alias("experiment_id"), F.lit(e["salt"]).alias("salt"))
        for e in EXPERIMENTS
    ]))
    units = (
        _load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
        .join(per_customer, "user_id", "left")
        .join(line_facts, "user_id", "left")
        .select("*", arms.alias("arm"))
        .select("*", "arm.*")
        .withColumn("bucketing_hash", bucket_hash(F.col("user_id"), F.col("salt")))
    )
    return conform(
        units.select(
            "user_id", "experiment_id",
            F.when(F.col("bucketing_hash") < 0.5, "control").otherwise("treatment").alias("variant"),
            "assign_ts", "bucketing_hash", "pre_covariate",
            F.coalesce("primary_metric", F.lit(0.0)).alias("primary_metric"),
            F.coalesce("guardrail_refund", F.lit(False)).alias("guardrail_refund"),
            F.coalesce("guardrail_latency_ms", F.lit(0.0)).alias("guardrail_latency_ms"),
        ),
        "experiment_assignment",
    )
