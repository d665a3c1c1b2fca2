"""Rule-based credit: five weights per touch, in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.config import CONVERSION, NULL_STATE, RULE_MODELS, AttributionConfig
from touchtally.functions.columns import EXACT, MONEY, exact_parts, exact_total, net_of_refund, steady_sum
from touchtally.operators.journeys import JourneyTouches, journey_steps

# A rule is a weight for a group of touches of one journey, in SQL over these
# columns: ``n`` touches, ``n_first`` and ``n_last`` of them the journey's first
# and last, ``decay`` their summed half-life weight; ``touches`` and
# ``decay_total`` are the journey's. A single touch is a group of one.
Rule = Callable[[AttributionConfig], Column]

# Largest error of a model's total credit, relative to the conversions plus one.
CREDIT_TOLERANCE = 1e-6


def _position_based(cfg: AttributionConfig) -> Column:
    first, middle, last = cfg.position_first, cfg.position_middle, cfg.position_last
    ends = f"(n_first * {first!r}D + n_last * {last!r}D)"
    return F.expr(f"""
        CASE WHEN touches = 1 THEN DOUBLE(n)
             WHEN touches = 2 THEN {ends} / {first + last!r}D
             ELSE {ends} + (n - n_first - n_last) * {middle!r}D / (touches - 2) END""")


RULES: dict[str, Rule] = {
    "first_touch": lambda cfg: F.expr("DOUBLE(n_first)"),
    "last_touch": lambda cfg: F.expr("DOUBLE(n_last)"),
    "linear": lambda cfg: F.expr("n / touches"),
    "time_decay": lambda cfg: F.expr("CASE WHEN decay_total > 0 THEN decay / decay_total ELSE n / touches END"),
    "position_based": _position_based,
}


def rule_weight(model: str, cfg: AttributionConfig) -> Column:
    if model not in RULES:
        raise ValueError(f"unknown rule model {model!r}; known: {sorted(RULES)}")
    return RULES[model](cfg)


def touch_weights(
    positions: DataFrame, cfg: AttributionConfig, models: Sequence[str] = RULE_MODELS
) -> DataFrame:
    """Credit weight of every touch of a converting journey, one column per model."""
    singles = positions.where("converted").selectExpr(
        "*", "1 AS n", "INT(pos_asc = 1) AS n_first", "INT(pos_desc = 1) AS n_last"
    )
    return singles.select(
        *positions.columns, *[rule_weight(m, cfg).alias(f"weight_{m}") for m in models]
    )


def known_channel(channels: Sequence[str]) -> Column:
    """The channel, failing the job on names outside the channel list."""
    return F.when(F.col("channel").isin(*channels), F.col("channel")).otherwise(
        F.raise_error(F.concat(F.lit("unknown channel: "), F.coalesce("channel", F.lit("NULL")))).cast("string")
    )


def channel_bit(channel: Column, channels: Sequence[str]) -> Column:
    """2**i for ``channels[i]``, as a long; 0 for all when there are more than 63, which only Shapley minds."""
    powers = F.create_map(*[F.lit(x) for i, c in enumerate(channels) for x in (c, 1 << i if len(channels) < 64 else 0)])
    return F.try_element_at(powers, channel).cast("long")


def attribution_facts(
    kept: JourneyTouches, cfg: AttributionConfig, models: Sequence[str] = RULE_MODELS
) -> DataFrame:
    """Everything the credit models need, in one pass over the journeys.

    Rows are (segment, from_state, to_state, channel_mask): at most
    (channels + 1) * channels rows for touches, and one row per outcome, last
    channel and channel set for journey ends. ``channel_mask`` has bit i set for
    ``cfg.channels[i]`` and is NULL on touch rows. Credit and revenue are exact decimals, so that
    they don't depend on the order of tasks. The touch log is shuffled
    once, for the join on user; later stages move aggregated rows.
    """
    channels = list(cfg.channels)
    segments = list(kept.segment_cols)
    known = kept.with_column("channel", known_channel(channels))
    steps = journey_steps(known, cfg, F.bit_or(channel_bit(F.col("channel"), channels))).withColumnRenamed("used", "mask")
    if kept.cut:
        of_all = F.aggregate("of_used", F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(channel_bit(c, channels)))
        steps = steps.withColumn("mask", F.coalesce(of_all, "mask"))
    rows = steps.select(
        *segments, "from_state", "channel", "converted", "n", "revenue", "is_refunded",
        *[F.when(F.col("converted"), rule_weight(m, cfg)).alias(f"credit_{m}") for m in models],
        F.expr("CASE WHEN n_last > 0 THEN mask END AS end_mask"),
    )
    measured = {
        **{f"credit_{m}": (f"credit_{m}", 6, 6) for m in models},
        **{f"revenue_{m}": (f"credit_{m} * revenue", *MONEY) for m in models},
        "revenue": ("CASE WHEN converted AND end_mask IS NOT NULL THEN revenue END", *MONEY),
    }
    # Refunded revenue is added up apart, so that the net needs no sums of its own.
    by_step = rows.groupBy(*segments, "from_state", "channel", "converted", "end_mask", "is_refunded").agg(
        F.expr("sum(n) AS transitions"), F.expr("count(end_mask) AS journeys"),
        *[part for name, (value, *units) in measured.items() for part in exact_parts(value, name, *units)],
    )
    by_step = by_step.selectExpr(
        *segments, "from_state", "channel", "converted", "end_mask", "is_refunded", "transitions", "journeys",
        *[f"{exact_total(name, *units)} AS {name}" for name, (_, *units) in measured.items()],
    )
    nets = {"net_revenue": "revenue", **{f"net_{m}": f"revenue_{m}" for m in models}}
    by_step = by_step.withColumns({net: net_of_refund(F.col(gross), F.col("is_refunded")).cast(EXACT) for net, gross in nets.items()})
    measured = [*[f"{kind}_{m}" for kind in ("credit", "revenue", "net") for m in models], "revenue", "net_revenue"]
    credit = measured[:-2]
    # From here on only these few rows are handled: touches and journey ends part.
    touch = ", ".join([
        "from_state AS from_state", "channel AS to_state", "BIGINT(NULL) AS channel_mask",
        "transitions AS transitions", *[f"{c} AS {c}" for c in credit],
        "0L AS journeys", "0L AS conversions", f"CAST(NULL AS {EXACT}) AS revenue", f"CAST(NULL AS {EXACT}) AS net_revenue",
    ])
    end = ", ".join([
        "channel AS from_state", f"IF(converted, '{CONVERSION}', '{NULL_STATE}') AS to_state",
        "end_mask AS channel_mask", "journeys AS transitions", *[f"CAST(NULL AS {EXACT}) AS {c}" for c in credit],
        "journeys AS journeys", "IF(converted, journeys, 0L) AS conversions",
        "revenue AS revenue", "net_revenue AS net_revenue",
    ])
    parted = by_step.selectExpr(
        *segments,
        f"explode(IF(end_mask IS NULL, array(struct({touch})), array(struct({touch}), struct({end})))) AS row",
    ).select(*segments, "row.*")
    keys = [*segments, "from_state", "to_state", "channel_mask"]
    totals = parted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parted.columns if c not in keys])
    return totals.select(*[F.col(c).cast(EXACT) if c in measured else F.col(c) for c in totals.columns])


def _per_channel(
    rows: DataFrame, segments: Sequence[str], channels: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Complete ``rows`` to one row per segment and channel, 0 where absent.

    ``rows`` has one row per segment and channel, so the list collected per
    segment is no longer than the channel list.
    """
    by_channel = F.map_from_entries(F.collect_list(F.struct("channel", F.struct(*measures))))
    found = F.try_element_at("by_channel", F.col("channel"))
    return (
        rows.groupBy(*segments)
        .agg(by_channel.alias("by_channel"))
        .select(*segments, "by_channel", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
        .select(*segments, "channel", *[F.coalesce(found[m], F.lit(0.0)).alias(m) for m in measures])
    )


def credit_by_channel(
    facts: DataFrame,
    cfg: AttributionConfig,
    models: Sequence[str] = RULE_MODELS,
    segment_cols: Sequence[str] = (),
) -> DataFrame:
    """Credited conversions and revenue per model and channel, zeros included.

    Columns: segment, model, channel, conversions, revenue, net_revenue. Fails the job
    when a model's credit does not add up to the conversions that the facts count.
    """
    segments = list(segment_cols)
    measures = [f"{kind}_{m}" for kind in ("credit", "revenue", "net") for m in models]
    within = Window.partitionBy(*segments)
    won = F.coalesce(F.sum("conversions").over(within), F.lit(0)).alias("won")
    by_channel = (
        facts.select("*", won).where(F.col("channel_mask").isNull())
        .groupBy(*segments, F.col("to_state").alias("channel"))
        .agg(*[F.sum(c).cast("double").alias(c) for c in measures], F.max("won").alias("won"))
    )
    checked = {
        f"credit_{m}": F.when(
            F.abs(F.coalesce(F.sum(f"credit_{m}").over(within), F.lit(0.0)) - F.col("won")) <= CREDIT_TOLERANCE * (1 + F.col("won")),
            F.col(f"credit_{m}"),
        ).otherwise(F.raise_error(F.lit(f"credit is not conserved by {m}")).cast("double"))
        for m in models
    }
    by_channel = by_channel.withColumns(checked).drop("won")
    whole = _per_channel(by_channel, segments, cfg.channels, measures)
    per_model = F.array(*[
        F.struct(
            F.lit(m).alias("model"),
            F.col(f"credit_{m}").alias("conversions"),
            F.col(f"revenue_{m}").alias("revenue"),
            F.col(f"net_{m}").alias("net_revenue"),
        )
        for m in models
    ])
    return whole.select(*segments, "channel", F.explode(per_model).alias("credit")).select(
        *segments, "credit.model", "channel", "credit.conversions", "credit.revenue", "credit.net_revenue"
    )


def credit_shares(credit: DataFrame, segment_cols: Sequence[str] = ()) -> DataFrame:
    """Share of all credited conversions per model and channel."""
    total = steady_sum(F.col("conversions"), Window.partitionBy(*segment_cols, "model"))
    return credit.select(
        *segment_cols, "model", "channel",
        F.when(total > 0, F.col("conversions") / total).alias("share"),
    )


def pivot_models(long: DataFrame, value: str, models: Sequence[str], segment_cols: Sequence[str] = ()) -> DataFrame:
    """One row per channel, one column per model."""
    return (
        long.groupBy(*segment_cols, "channel").pivot("model", list(models)).agg(F.first(value))
    )


def conservation(facts: DataFrame, models: Sequence[str] = RULE_MODELS, tolerance: float = 1e-6) -> DataFrame:
    """Per model: total credit against the number of converting journeys."""
    totals = facts.agg(
        F.coalesce(F.sum("conversions"), F.lit(0)).alias("conversions"),
        *[F.coalesce(F.sum(f"credit_{m}").cast("double"), F.lit(0.0)).alias(m) for m in models],
    )
    return totals.unpivot(["conversions"], list(models), "model", "credited").withColumn(
        "conserved", F.abs(F.col("credited") - F.col("conversions")) <= F.lit(tolerance)
    )


def require_conservation(credit: DataFrame, conversions: int | float, tolerance: float = 1e-6) -> DataFrame:
    """Fail the job when a model's credit does not add up to ``conversions``."""
    total = F.sum("conversions").over(Window.partitionBy("model"))
    return credit.withColumn(
        "conversions",
        F.when(F.abs(total - F.lit(float(conversions))) <= F.lit(tolerance), F.col("conversions")).otherwise(
            F.raise_error(F.concat(F.lit("credit is not conserved by "), F.col("model"))).cast("double")
        ),
    )
