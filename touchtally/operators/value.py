"""Spend, credited value, budget moves and recovery error, whole or per segment.

All inputs but the spend log are facts or channel tables: a few rows per segment and model. Windows here span
one model's channels in one segment. Totals don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.config import (
    DATA_DRIVEN_MODELS,
    DAYS_PER_MONTH,
    RULE_MODELS,
    AttributionConfig,
)
from touchtally.functions.columns import EXACT, MONEY, clip, exact_parts, exact_total, guarded_ratio, steady_sum
from touchtally.operators.markov import markov_attribution
from touchtally.operators.rules import RULES, credit_by_channel, credit_shares
from touchtally.operators.shapley import shapley_credit

ALL_MODELS = (*RULE_MODELS, *DATA_DRIVEN_MODELS)


def spend_basis(spend: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()) -> DataFrame:
    """(segment, channel, monthly_spend, months) in one read of the spend log.

    ``monthly_spend`` is over the channel's own days, 0 without spend; ``months`` are those that the
    segment's whole log covers, other channels included. Days are bitmaps, so both distinct
    counts come from one aggregate. Segment columns that the log doesn't have are left out of the result.
    """
    segments = [c for c in segment_cols if c in spend.columns]
    day = F.datediff("date", F.lit("0001-01-01").cast("date")) + 1
    per_channel = spend.groupBy(*segments, "channel", F.bitmap_bucket_number(day).alias("span")).agg(
        *exact_parts("spend", "spend", *MONEY), F.bitmap_construct_agg(F.bitmap_bit_position(day)).alias("bits")
    )
    entry = F.struct("channel", F.expr(exact_total("spend", *MONEY)).alias("spend"), F.bitmap_count("bits").alias("days"))
    # A span is 32,768 days, so there are one or two; from here on a row or two per channel are handled.
    whole = (
        per_channel.groupBy(*segments, "span")
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("all_days"), F.collect_list(entry).alias("entries"))
        .groupBy(*segments)
        .agg(F.coalesce(F.sum("all_days"), F.lit(0)).alias("all_days"), F.flatten(F.collect_list("entries")).alias("entries"))
    )
    own = F.filter("entries", lambda e: e["channel"] == F.col("channel"))

    def total(name: str, kind: str) -> Column:
        return F.aggregate(own, F.lit(0).cast(kind), lambda t, e: (t + F.coalesce(e[name], F.lit(0))).cast(kind))

    monthly = total("spend", EXACT).cast("double") / (total("days", "long") / F.lit(DAYS_PER_MONTH))
    return whole.select("*", F.explode(F.array(*map(F.lit, channels))).alias("channel")).select(
        *segments, "channel",
        F.when(total("days", "long") > 0, monthly).otherwise(F.lit(0.0)).alias("monthly_spend"),
        F.when(F.col("all_days") > 0, F.col("all_days") / F.lit(DAYS_PER_MONTH))
        .otherwise(F.raise_error(F.lit("spend is empty: no monthly basis")).cast("double"))
        .alias("months"),
    )


def channel_spend(spend: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()) -> DataFrame:
    """Monthly spend per channel over the channel's own days; 0 without spend."""
    return spend_basis(spend, channels, segment_cols).drop("months")


def data_driven_shares(
    facts: DataFrame, channels: Sequence[str], models: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """(segment, model, channel, share, reason); a segment without a result has NULL shares and says why."""
    segments, parts = list(segment_cols), []
    if "markov" in models:
        parts.append(("markov", markov_attribution(facts, channels, segments)))
    if "shapley" in models:
        parts.append(("shapley", shapley_credit(facts, channels, segments)))
    frames = [df.select(*segments, F.lit(model).alias("model"), "channel", "share", "reason") for model, df in parts]
    return reduce(DataFrame.unionByName, frames)


def _split_models(models: Sequence[str]) -> tuple[list[str], list[str]]:
    known = [*RULES, *DATA_DRIVEN_MODELS]
    unknown = sorted(set(models) - set(known))
    if unknown or not models:
        raise ValueError(f"unknown models {unknown}; known: {known}")
    return [m for m in models if m in RULES], [m for m in models if m in DATA_DRIVEN_MODELS]


def attribution_shares(
    facts: DataFrame, cfg: AttributionConfig, models: Sequence[str] = ALL_MODELS, segment_cols: Sequence[str] = ()
) -> DataFrame:
    """(segment, model, channel, share, reason) for rule and data-driven models."""
    rules, driven = _split_models(models)
    segments, parts = list(segment_cols), []
    if rules:
        shares = credit_shares(credit_by_channel(facts, cfg, rules, segments), segments)
        parts.append(shares.withColumn("reason", F.when(F.col("share").isNull(), "no journey converts")))
    if driven:
        parts.append(data_driven_shares(facts, cfg.channels, driven, segments))
    return reduce(DataFrame.unionByName, parts)


def credited_value(
    facts: DataFrame, cfg: AttributionConfig, models: Sequence[str] = ALL_MODELS, segment_cols: Sequence[str] = ()
) -> DataFrame:
    """(segment, model, channel, conversions, net_revenue) credited under each model.

    Rules credit each journey; the data-driven models spread the segment's totals by share.
    """
    rules, driven = _split_models(models)
    segments, parts = list(segment_cols), []
    if rules:
        credit = credit_by_channel(facts, cfg, rules, segments)
        parts.append(credit.select(*segments, "model", "channel", "conversions", "net_revenue"))
    if driven:
        totals = facts.groupBy(*segments).agg(
            F.coalesce(F.sum("conversions"), F.lit(0)).alias("won"),
            F.coalesce(F.sum("net_revenue").cast("double"), F.lit(0.0)).alias("net"),
        )
        shares = data_driven_shares(facts, cfg.channels, driven, segments)
        parts.append(_beside(shares, totals, segments).select(
            *segments, "model", "channel",
            (F.col("share") * F.col("won")).alias("conversions"), (F.col("share") * F.col("net")).alias("net_revenue"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _beside(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the columns of the one row of ``facts`` that has the same keys; NULL is a key like others."""
    if not keys:
        return rows.crossJoin(F.broadcast(facts))  # one row
    named = facts.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, reduce(Column.__and__, same), how).drop(*[f"_{k}" for k in keys])


def roi_table(
    credited: DataFrame, spend: DataFrame, channels: Sequence[str], months: float | None = None,
    segment_cols: Sequence[str] = (),
) -> DataFrame:
    """Spend, credited value, shares, CAC and ROAS per segment, model and channel, per month.

    CAC is NULL without credit and ROAS without spend. A segment has its own spend where the spend log has the
    segment's columns, else the whole log's; one that the log doesn't mention has no monthly basis. ``reason``
    says why a row has no value share.
    """
    segments = list(segment_cols)
    per_model = Window.partitionBy(*segments, "model")
    basis = spend_basis(spend, channels, segments)
    keys = [*[c for c in segments if c in spend.columns], "channel"]
    over = F.lit(float(months)) if months is not None else F.col("months")
    joined = _beside(credited, basis, keys, "left").select(
        *segments, "model", "channel", F.coalesce("monthly_spend", F.lit(0.0)).alias("monthly_spend"),
        (F.col("conversions") / over).alias("credited_conversions"),
        (F.col("net_revenue") / over).alias("credited_revenue"),
        over.isNull().alias("unmeasured"),
    )
    spent, won = F.col("monthly_spend"), F.col("credited_conversions")
    rows = joined.select(
        "*", guarded_ratio(spent, steady_sum(spent, per_model)).alias("spend_share"),
        guarded_ratio(won, steady_sum(won, per_model)).alias("value_share"),
    )
    return rows.select(
        *segments, "model", "channel", "monthly_spend", "credited_conversions", "credited_revenue", "spend_share", "value_share",
        guarded_ratio(spent, won).alias("cac"),
        guarded_ratio(F.col("credited_revenue"), spent).alias("roas"),
        F.when(F.col("unmeasured"), "no spend in the segment: no monthly basis")
        .when(F.col("value_share").isNull(), "the model gives no value shares")
        .alias("reason"),
    )


def reallocation_plan(roi: DataFrame, max_shift: float = 0.30, segment_cols: Sequence[str] = ()) -> DataFrame:
    """Budget-neutral move toward value share, at most ``max_shift`` of a channel's spend, in each segment.

    Every channel goes to its share of the budget or as near as it may. The sum then misses the budget; all channels go
    the same part of the way from there to the bound on that side. A model without value shares has
    no plan: NULLs, and the reason.
    """
    if not 0 <= max_shift <= 1:
        raise ValueError("max_shift must be in [0, 1]")
    segments = list(segment_cols)
    within = Window.partitionBy(*segments, "model")
    spent, near = F.col("monthly_spend"), F.col("near")
    placed = (
        roi.withColumn("budget", steady_sum(spent, within))
        .withColumn("low", spent * (1.0 - max_shift))
        .withColumn("high", spent * (1.0 + max_shift))
        .withColumn("near", clip(F.col("value_share") * F.col("budget"), F.col("low"), F.col("high")))
        .withColumn("short", F.col("budget") - steady_sum(near, within))
        .withColumn("bound", F.when(F.col("short") > 0, F.col("high")).otherwise(F.col("low")))
        .withColumn("reach", F.abs(steady_sum(F.col("bound") - near, within)))
    )
    # Less than this is rounding.
    part = F.when((F.abs("short") > 1e-9) & (F.col("reach") > 1e-9), F.abs("short") / F.col("reach")).otherwise(F.lit(0.0))
    planned = placed.withColumn("proposed_spend", near + part * (F.col("bound") - near)).withColumn(
        "delta", F.col("proposed_spend") - spent
    )
    return planned.select(
        *segments, "model", "channel", spent.alias("current_spend"), "spend_share", "value_share", "proposed_spend",
        "delta", guarded_ratio(F.col("delta"), spent).alias("delta_pct"), "cac", "roas",
        guarded_ratio(F.col("delta") * F.col("credited_conversions"), spent).alias("delta_conversions"),
        guarded_ratio(F.col("delta") * F.col("credited_revenue"), spent).alias("delta_revenue"),
        F.when(F.col("delta").isNull(), F.col("reason") if "reason" in roi.columns else F.lit("the model gives no value shares")).alias("reason"),
    )


def reallocation_summary(plan: DataFrame, segment_cols: Sequence[str] = ()) -> DataFrame:
    """Dollars moved and expected change in conversions and revenue per segment and model."""
    moved = F.when(F.col("delta").isNotNull(), F.greatest("delta", F.lit(0.0)))
    return plan.groupBy(*segment_cols, "model").agg(
        steady_sum(moved).alias("dollars_moved"),
        steady_sum(F.col("delta_conversions")).alias("expected_incremental_conversions"),
        steady_sum(F.col("delta_revenue")).alias("expected_incremental_revenue"),
    )


def misallocation(
    roi: DataFrame, incumbent: str = "last_touch", challenger: str = "shapley", segment_cols: Sequence[str] = ()
) -> DataFrame:
    """Dollars per channel that two models point differently, and their total in the segment.

    ``total_misallocated`` counts each misplaced dollar once.
    """
    segments = list(segment_cols)
    budget = steady_sum(F.col("monthly_spend"), Window.partitionBy(*segments, "model"))
    implied = roi.where(F.col("model").isin(incumbent, challenger)).withColumn("implied", F.col("value_share") * budget)
    per_channel = implied.groupBy(*segments, "channel").agg(
        F.max(F.when(F.col("model") == incumbent, F.col("implied"))).alias("implied_by_incumbent"),
        F.max(F.when(F.col("model") == challenger, F.col("implied"))).alias("implied_by_challenger"),
    ).withColumn("difference", F.col("implied_by_challenger") - F.col("implied_by_incumbent"))
    return per_channel.withColumn(
        "total_misallocated", steady_sum(F.abs("difference"), Window.partitionBy(*segments)) / 2
    )


def recovery_scores(
    shares: DataFrame, truth: DataFrame, baseline: str = "last_touch", segment_cols: Sequence[str] = ()
) -> DataFrame:
    """Error of each model's shares against the true ones, best first in each segment; models without shares last.

    ``truth`` holds for all segments, or for each if it has the segment columns.
    """
    segments = list(segment_cols)
    error = F.abs(F.col("share") - F.col("true_share"))
    own = [*[c for c in segments if c in truth.columns], "channel"]
    scores = (
        _beside(shares, truth, own)
        .groupBy(*segments, "model")
        .agg(
            F.avg(error).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.max(error).alias("max_abs_error"),
            *[F.max("reason").alias("reason") for _ in {"reason"} & set(shares.columns)],
        )
    )
    base = F.max(F.when(F.col("model") == baseline, F.col("mae"))).over(Window.partitionBy(*segments))
    return scores.withColumn("error_reduction_vs_baseline", F.lit(1.0) - guarded_ratio(F.col("mae"), base)).orderBy(
        *segments, F.asc_nulls_last("mae"), "model"
    )


def shares_against_truth(shares: DataFrame, truth: DataFrame, segment_cols: Sequence[str] = ()) -> DataFrame:
    own = [*[c for c in segment_cols if c in truth.columns], "channel"]
    return _beside(shares, truth, own).select(*segment_cols, "model", "channel", "share", "true_share")
