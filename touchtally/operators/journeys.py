"""Journeys: touches joined to the user's first conversion, windowed and ordered."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.config import PATH_SEPARATOR, START, AttributionConfig
from touchtally.functions.columns import (
    age_days,
    calendar_days,
    half_life_weight,
    net_of_refund,
)
from touchtally.functions import prints
from touchtally.operators import slices
from touchtally.sources.checkpoints import broadcast_if_small, materialise

_USER_FACTS = ("converted", "convert_ts", "revenue", "is_refunded")
# Channels of a path that are kept as text beside its key.
HEAD_CHANNELS = 64


@dataclass(frozen=True)
class JourneyTouches:
    """Touches with their user's conversion, in one frame partitioned by (user_id, slice).

    ``slice`` is 0 for users that fit one task, so that a slice is the whole journey. With
    ``cut``, the few users above the limit are in slices 1, 2, ... in order of their touches;
    what an operator needs from the other slices of such a user comes from ``slice_facts``.
    """

    touches: DataFrame
    cut: bool = False
    segment_cols: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        return self.touches

    def where(self, keep: Column) -> JourneyTouches:
        return replace(self, touches=self.touches.where(keep))

    def with_column(self, name: str, value: Column) -> JourneyTouches:
        return replace(self, touches=self.touches.withColumn(name, value))

    @property
    def user_cols(self) -> list[str]:
        return ["user_id", *self.segment_cols]

    @property
    def slice_cols(self) -> list[str]:
        return ["user_id", "slice", *self.segment_cols]


def conversion_rollup(conversions: DataFrame) -> DataFrame:
    """One row per converting user: first conversion, summed revenue, any refund."""
    return conversions.groupBy("user_id").agg(
        F.min("convert_ts").alias("convert_ts"),
        F.sum("revenue").alias("revenue"),
        F.bool_or("is_refunded").alias("is_refunded"),
    )


def touch_quality(touches: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Counts of touches that journeys leave out or that credit would refuse."""
    known = F.coalesce(F.col("channel").isin(*channels), F.lit(False))
    return touches.agg(
        F.count("*").alias("touches"),
        F.count_if(F.col("ts").isNull()).alias("without_ts"),
        F.count_if(F.col("user_id").isNull()).alias("without_user"),
        F.count_if(~known).alias("unknown_channel"),
    )


def journey_source(
    touches: DataFrame,
    conversions: DataFrame,
    cfg: AttributionConfig,
    segment_cols: Sequence[str] = (),
) -> JourneyTouches:
    """Touches left-joined to the conversion roll-up.

    Touches without user or timestamp cannot be placed and are left out;
    ``touch_quality`` counts them. ``segment_cols`` are touch columns that are
    constant per user.
    """
    segments = tuple(segment_cols)
    placed = touches.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select(
        "user_id", "touch_id", "ts", "channel", *segments
    )
    rollup = conversion_rollup(conversions).withColumn("converted", F.lit(True))
    cuts = None if cfg.hot_user_rows is None else slices.user_cuts(placed, cfg.hot_user_rows)
    if cuts is None:
        joined = placed.withColumn("slice", F.lit(0).cast("long")).join(rollup, "user_id", "left")
    else:
        # Bounded by slices.MAX_HEAVY_USERS and MAX_CUTS.
        few = F.broadcast(cuts)
        sliced = placed.join(few, "user_id", "left").withColumn("slice", slices.slice_number()).drop("cuts")
        # Every slice meets its user's conversion, so a hot user's touches are joined in many tasks.
        each = rollup.join(few, "user_id", "left").withColumn("slice", F.explode(slices.slice_numbers())).drop("cuts")
        joined = sliced.join(each, ["user_id", "slice"], "left")
    shaped = joined.select(
        "user_id", "slice", "touch_id", "ts", "channel", *segments,
        F.coalesce("converted", F.lit(False)).alias("converted"),
        "convert_ts",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("is_refunded", F.lit(False)).alias("is_refunded"),
        age_days(F.col("ts"), F.col("convert_ts")).alias("age_days"),
    )
    return JourneyTouches(shaped, cuts is not None, segments)


def within_lookback(source: JourneyTouches, cfg: AttributionConfig) -> JourneyTouches:
    """Drop converters' touches after the conversion or older than the lookback."""
    age = F.col("age_days")
    reach = age if cfg.lookback_mode == "fractional" else calendar_days(F.col("ts"), F.col("convert_ts"))
    inside = F.col("convert_ts").isNull() | ((age >= 0) & (reach <= F.lit(float(cfg.lookback_days))))
    return source.where(inside)


def build_touches(
    touches: DataFrame,
    conversions: DataFrame,
    cfg: AttributionConfig,
    segment_cols: Sequence[str] = (),
) -> JourneyTouches:
    """The eligible touches of every journey."""
    return within_lookback(journey_source(touches, conversions, cfg, segment_cols), cfg)


def _decay(cfg: AttributionConfig) -> Column:
    return F.when(F.col("converted"), half_life_weight(F.col("age_days"), cfg.half_life_days))


def _journey_facts(cfg: AttributionConfig) -> list[Column]:
    """Aggregates over the touches of a journey, or of a slice."""
    order = F.struct("ts", "touch_id")
    return [
        F.count("*").alias("touches"), F.sum(_decay(cfg)).alias("decay_total"),
        F.min_by("channel", order).alias("first_channel"), F.max_by("channel", order).alias("last_channel"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.collect_set("channel").alias("used"),
        *[F.max(name).alias(name) for name in _USER_FACTS],
    ]


def slice_facts(kept: JourneyTouches, cfg: AttributionConfig) -> DataFrame:
    """What each slice of a cut user has to know of the user's other slices, written.

    ``earlier`` touches and the ``before`` channel precede the slice, ``closes`` marks the last
    one; the other columns are the whole journey's.
    """
    per_slice = kept.touches.where("slice > 0").groupBy(*kept.slice_cols).agg(*_journey_facts(cfg))
    user = Window.partitionBy("user_id")
    ordered = user.orderBy("slice")
    until = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = {
        "touches": F.sum("touches").over(user), "decay_total": F.sum("decay_total").over(user),
        "first_ts": F.min("first_ts").over(user), "last_ts": F.max("last_ts").over(user),
        "first_channel": F.min_by("first_channel", "slice").over(user),
        "last_channel": F.max_by("last_channel", "slice").over(user),
        "used": F.array_distinct(F.flatten(F.collect_set("used").over(user))),
    }
    return materialise(per_slice.select(
        *kept.slice_cols, F.coalesce(F.sum("touches").over(until), F.lit(0)).alias("earlier"),
        F.lag("last_channel").over(ordered).alias("before"),
        F.lead("slice").over(ordered).isNull().alias("closes"),
        *[value.alias(name) for name, value in whole.items()], *_USER_FACTS,
    ))


def with_slice_facts(kept: JourneyTouches, rows: DataFrame, cfg: AttributionConfig, *names: str) -> DataFrame:
    """rows with named columns of their slice's facts, as ``of_<name>``; NULL where the slice is the journey."""
    if not kept.cut:
        return rows
    # A row per slice of the cut users.
    facts = broadcast_if_small(slice_facts(kept, cfg).select("user_id", "slice", *[F.col(n).alias(f"of_{n}") for n in names]), slices.MAX_CUTS)
    return rows.join(facts, ["user_id", "slice"], "left")


def touch_positions(kept: JourneyTouches, cfg: AttributionConfig) -> DataFrame:
    """Eligible touches with ``pos_asc``, ``pos_desc``, ``touches`` and decay weight.

    ``decay`` is the raw half-life weight and ``decay_total`` its journey sum;
    both are NULL for journeys without a conversion.
    """
    here = Window.partitionBy(*kept.slice_cols)
    rows = (
        kept.touches.withColumn("decay", _decay(cfg))
        .withColumn("pos_asc", F.row_number().over(here.orderBy("ts", "touch_id")).cast("long"))
        .withColumn("touches", F.count("*").over(here))
        .withColumn("decay_total", F.sum("decay").over(here))
    )
    if kept.cut:
        rows = (
            with_slice_facts(kept, rows, cfg, "earlier", "touches", "decay_total")
            .withColumn("pos_asc", F.col("pos_asc") + F.coalesce("of_earlier", F.lit(0)))
            .withColumn("decay_total", F.when(F.col("slice") > 0, F.col("of_decay_total")).otherwise(F.col("decay_total")))
            .withColumn("touches", F.coalesce("of_touches", "touches"))
            .drop("of_earlier", "of_touches", "of_decay_total")
        )
    return rows.withColumn("pos_desc", F.col("touches") - F.col("pos_asc") + 1)


def journey_steps(kept: JourneyTouches, cfg: AttributionConfig, used: Column | None = None) -> DataFrame:
    """Eligible touches as rows that only have to be added up.

    ``n`` is 1, ``n_first`` and ``n_last`` mark the journey's ends, ``from_state`` is the channel before; ``touches``
    and ``decay_total`` are the journey's. ``used`` is an aggregate over the channels of a slice, given as an
    expression of ``channel``, and makes a column ``used`` of it; for cut users that holds one slice only, beside ``of_used``,
    the list of the journey's channels.
    """
    here = Window.partitionBy(*kept.slice_cols)
    ordered = here.orderBy("ts", "touch_id")
    rows = kept.touches.select(
        *kept.slice_cols, "channel", F.lag("channel", 1, START).over(ordered).alias("from_state"),
        F.lead("channel", 1, START).over(ordered).eqNullSafe(START).alias("last"),
        _decay(cfg).alias("decay"), F.count("*").over(here).alias("touches"),
        F.sum(_decay(cfg)).over(here).alias("decay_total"),
        *([] if used is None else [used.over(here).alias("used")]), *_USER_FACTS,
    )
    if kept.cut:
        opens = F.col("from_state").eqNullSafe(START) & F.col("of_before").isNotNull()
        rows = (
            with_slice_facts(kept, rows, cfg, "before", "closes", "touches", "decay_total", "used")
            .withColumn("from_state", F.when(opens, F.col("of_before")).otherwise(F.col("from_state")))
            .withColumn("last", F.col("last") & F.coalesce("of_closes", F.lit(True)))
            .withColumn("decay_total", F.when(F.col("slice") > 0, F.col("of_decay_total")).otherwise(F.col("decay_total")))
            .withColumn("touches", F.coalesce("of_touches", "touches"))
        )
    return rows.select(
        "*", F.lit(1).cast("long").alias("n"), F.col("from_state").eqNullSafe(START).cast("long").alias("n_first"),
        F.col("last").cast("long").alias("n_last"),
    )


def journeys(kept: JourneyTouches, cfg: AttributionConfig) -> DataFrame:
    """One row per user with at least one eligible touch (no path)."""
    touches = kept.touches.where("slice = 0") if kept.cut else kept.touches
    rows = touches.groupBy(*kept.slice_cols).agg(*_journey_facts(cfg))
    if kept.cut:
        rows = rows.unionByName(slice_facts(kept, cfg).where("closes").select(*rows.columns))
    return rows.withColumn("distinct_channels", F.size("used")).drop("slice", "used").withColumn(
        "net_revenue", net_of_refund(F.col("revenue"), F.col("is_refunded"))
    )


def journey_counts(journey_rows: DataFrame) -> DataFrame:
    return journey_rows.agg(
        F.count("*").alias("journeys"),
        F.count_if("converted").alias("conversions"),
        F.sum("touches").alias("touches"),
    )


def distinct_channel_counts(journey_rows: DataFrame) -> DataFrame:
    """How many journeys touch one channel, two channels, and so on."""
    return journey_rows.groupBy("distinct_channels").agg(
        F.count("*").alias("journeys"), F.count_if("converted").alias("conversions")
    )


def _ordered_channels(touch_structs: Column) -> Column:
    return F.transform(F.array_sort(touch_structs), lambda t: t["channel"])


def _touch_list() -> Column:
    return F.collect_list(F.struct("ts", "touch_id", "channel"))


def path_segments(kept: JourneyTouches) -> DataFrame:
    """Paths in pieces: one row for a regular user, one per slice for a hot one.

    Read in ``slice`` order, a user's pieces are its whole path.
    """
    return kept.touches.groupBy(*kept.slice_cols).agg(
        F.count("*").alias("touches"), _ordered_channels(_touch_list()).alias("channels")
    )


def journey_paths(kept: JourneyTouches, cfg: AttributionConfig) -> DataFrame:
    """One row per journey with its ordered ``channels`` and ``path`` string.

    The row holds the whole path, because that is what is asked for; ``path_keys`` doesn't need it.
    """
    facts = [F.max(name).alias(name) for name in _USER_FACTS]
    spans = [F.min("ts").alias("first_touch_ts"), F.max("ts").alias("last_touch_ts")]
    rows = kept.touches.groupBy(*kept.slice_cols).agg(
        F.count("*").alias("touch_count"), _ordered_channels(_touch_list()).alias("channels"), *spans, *facts
    )
    if kept.cut:
        ordered = F.array_sort(F.collect_list(F.struct("slice", "channels")))
        rows = rows.groupBy(*kept.user_cols).agg(
            F.sum("touch_count").alias("touch_count"),
            F.flatten(F.transform(ordered, lambda s: s["channels"])).alias("channels"),
            F.min("first_touch_ts").alias("first_touch_ts"), F.max("last_touch_ts").alias("last_touch_ts"), *facts,
        )
    return rows.drop("slice").select(
        "*", F.size(F.array_distinct("channels")).alias("distinct_channels"),
        F.get("channels", F.lit(0)).alias("first_channel"), F.element_at("channels", -1).alias("last_channel"),
        F.array_join("channels", PATH_SEPARATOR).alias("path"),
        net_of_refund(F.col("revenue"), F.col("is_refunded")).alias("net_revenue"),
    )


def path_keys(kept: JourneyTouches) -> DataFrame:
    """One row per journey with a fingerprint of its path, never the path itself.

    ``path_key`` has the number of named channels and two polynomial hashes of them modulo a prime: the i-th channel's
    value times base**i, summed. Sums over slices are put together by the lengths before them, so a
    journey in slices has the key that it would have in one piece. ``head`` is the text of the first
    ``HEAD_CHANNELS``, ending in a separator where the path goes on. As in the text, a NULL channel doesn't count.
    """
    place = F.count("channel").over(Window.partitionBy(*kept.slice_cols).orderBy("ts", "touch_id"))
    placed = kept.touches.withColumn("place", place)
    head = F.when(F.col("channel").isNotNull() & (F.col("place") <= HEAD_CHANNELS), F.struct("place", "channel"))
    facts = [F.max(name).alias(name) for name in _USER_FACTS]
    rows = placed.groupBy(*kept.slice_cols).agg(
        F.count("*").alias("touch_count"), F.count("channel").alias("length"),
        *[prints.residue_sum(prints.term("channel", "place", k)).alias(f"h{k}") for k in range(prints.HASHES)],
        F.collect_list(head).alias("head"), *facts,
    ).withColumn("head", F.transform(F.array_sort("head"), lambda x: x["channel"]))
    if kept.cut:
        parts = F.array_sort(F.collect_list(F.struct("slice", "length", *[f"h{k}" for k in range(prints.HASHES)], "head")))
        rows = rows.groupBy(*kept.user_cols).agg(F.sum("touch_count").alias("touch_count"), parts.alias("parts"), *facts)
        rows = rows.select(
            *kept.user_cols, "touch_count", *_USER_FACTS,
            F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
            *[prints.joined("parts", k).alias(f"h{k}") for k in range(prints.HASHES)],
            # Parts shorter than the head are few: the first ones only are looked at.
            F.slice(F.flatten(F.transform("parts", lambda x: x["head"])), 1, HEAD_CHANNELS).alias("head"),
        )
    text = F.concat(F.array_join("head", PATH_SEPARATOR), F.when(F.col("length") > HEAD_CHANNELS, PATH_SEPARATOR).otherwise(""))
    return rows.select(
        *kept.user_cols, "touch_count", *_USER_FACTS,
        F.struct("length", *[f"h{k}" for k in range(prints.HASHES)]).alias("path_key"), text.alias("head"),
    )


def path_texts(kept: JourneyTouches, users: DataFrame) -> DataFrame:
    """user_id and whole ``path`` of a few users."""
    rows = kept.touches.join(F.broadcast(users.select("user_id")), "user_id", "left_semi")
    pieces = rows.groupBy("user_id", "slice").agg(_ordered_channels(_touch_list()).alias("channels"))
    ordered = F.array_sort(F.collect_list(F.struct("slice", "channels")))
    whole = F.flatten(F.transform(ordered, lambda s: s["channels"]))
    return pieces.groupBy("user_id").agg(F.array_join(whole, PATH_SEPARATOR).alias("path"))


def frequent_paths(kept: JourneyTouches, top_n: int, *measures: Column) -> DataFrame:
    """The most frequent converting paths with ``conversions`` and ``measures``, ties broken by path.

    Journeys meet by their path's key. Texts are read for the top rows only, and only if one of them is
    longer than its head; then the paths that begin like the last row's are candidates too, for whole texts decide.
    """
    # The head follows from the key.
    grouped = path_keys(kept).where("converted").groupBy("path_key", "head").agg(
        F.count("*").alias("conversions"), *measures, F.min("user_id").alias("user_id")
    )
    top = materialise(grouped.orderBy(F.desc("conversions"), "head").limit(top_n))
    if top.where(F.col("path_key.length") > HEAD_CHANNELS).isEmpty():
        return top.withColumn("path", F.col("head")).drop("path_key", "head", "user_id").orderBy(F.desc("conversions"), "path")
    last = top.orderBy("conversions", F.desc("head")).first()
    tied = (F.col("conversions") == last["conversions"]) & (F.col("head") <= last["head"])
    candidates = materialise(grouped.where((F.col("conversions") > last["conversions"]) | tied))
    return (
        candidates.join(path_texts(kept, candidates), "user_id").drop("path_key", "head", "user_id")
        .orderBy(F.desc("conversions"), "path")
        .limit(top_n)
    )


def path_summary(kept: JourneyTouches, top_n: int = 10) -> DataFrame:
    """The most frequent converting paths, ties broken by path."""
    top = frequent_paths(kept, top_n, F.sum("revenue").alias("revenue"), F.max("touch_count").alias("path_length"))
    return top.select("path", "conversions", "revenue", "path_length")
