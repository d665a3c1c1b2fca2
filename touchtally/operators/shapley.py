"""Shapley credit over channel sets.

Journeys are reduced to channel bitmasks first; everything after that is sized
by the number of channel sets. Channels that no journey has are null players with value 0 and
leave the game. Up to ``MAX_CHANNELS`` seen channels all coalitions are valued exactly; above, permutations are
sampled and every channel has a standard error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchtally.functions.columns import steady_sum

# Bits widened per pass: one pass turns a row into at most 2**8 rows.
_BITS_PER_PASS = 8
MAX_CHANNELS = 20
# Bits of a channel set.
MAX_DECLARED = 63
# Sampled permutations: so many blocks, each with all rotations of one random order.
BLOCKS = 64


def _check(channels: Sequence[str]) -> None:
    if len(channels) > MAX_CHANNELS:
        raise ValueError(f"coalitions are listed for at most {MAX_CHANNELS} channels; shapley_credit samples beyond that")


def channel_set_counts(facts: DataFrame, segment_cols: Sequence[str] = ()) -> DataFrame:
    """Journeys and conversions per exact channel set."""
    return (
        facts.where(F.col("channel_mask").isNotNull())
        .groupBy(*segment_cols, "channel_mask")
        .agg(F.sum("journeys").alias("journeys"), F.sum("conversions").alias("conversions"))
    )


def coalition_values(
    facts: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """(coalition, members, support, conversions, value) for all 2**n coalitions.

    ``support`` is the number of journeys whose channel set lies inside the
    coalition and ``value`` their conversion rate, 0 without support. Each pass
    hands a set's counts to its supersets in a block of bits and adds up, so no
    pairs of coalitions are formed. A zero row for the empty set makes every
    coalition appear.
    """
    _check(channels)
    segments = list(segment_cols)
    n = len(channels)
    empty = F.struct(
        F.lit(0).cast("long").alias("coalition"), F.lit(0).cast("long").alias("support"),
        F.lit(0).cast("long").alias("conversions"),
    )
    own = F.struct(F.col("channel_mask").alias("coalition"), F.col("journeys").alias("support"), "conversions")
    rows = (
        channel_set_counts(facts, segments)
        .select(*segments, F.explode(F.array(own, empty)).alias("row"))
        .select(*segments, "row.*")
    )
    for low in range(0, n, _BITS_PER_PASS):
        width = min(_BITS_PER_PASS, n - low)
        block = ((1 << width) - 1) << low
        inside = F.col("coalition").bitwiseAND(F.lit(block))
        supersets = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda s: F.shiftleft(s.cast("long"), low)),
            lambda s: s.bitwiseAND(inside) == inside,
        )
        rows = (
            rows.select(*segments, "coalition", "support", "conversions", F.explode(supersets).alias("wider"))
            .groupBy(*segments, F.col("coalition").bitwiseOR(F.col("wider")).alias("coalition"))
            .agg(F.sum("support").alias("support"), F.sum("conversions").alias("conversions"))
        )
    members = F.filter(
        F.array(*[F.when(F.col("coalition").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(channels)]),
        lambda c: c.isNotNull(),
    )
    return rows.select(
        *segments, "coalition", F.array_join(members, "+").alias("members"), "support", "conversions",
        F.when(F.col("support") > 0, F.col("conversions") / F.col("support")).otherwise(F.lit(0.0)).alias("value"),
    )


def shapley_attribution(
    values: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """Shapley value ``phi`` and share per channel from the coalition values.

    Every coalition adds its value, weighted, to the channels inside it and takes
    it from those outside, which sums the marginal contributions without pairing
    coalitions. Negative values count as 0 in the shares only.
    """
    _check(channels)
    segments = list(segment_cols)
    n = len(channels)
    size = F.bit_count("coalition")
    gain = F.array(*[F.lit(factorial(s - 1) * factorial(n - s) / factorial(n) if s else 0.0) for s in range(n + 1)])
    loss = F.array(*[F.lit(factorial(s) * factorial(n - s - 1) / factorial(n) if s < n else 0.0) for s in range(n + 1)])
    parts = F.array(*[
        F.struct(
            F.lit(c).alias("channel"),
            (
                F.col("value")
                * F.when(F.col("coalition").bitwiseAND(F.lit(1 << i)) != 0, F.get(gain, size))
                .otherwise(-F.get(loss, size))
            ).alias("part"),
        )
        for i, c in enumerate(channels)
    ])
    phi = (
        values.select(*segments, F.explode(parts).alias("p"))
        .groupBy(*segments, "p.channel")
        # Parts add up to at most 1 on either side; as whole numbers their order doesn't matter.
        .agg((F.sum(F.round(F.col("p.part") * F.lit(2.0**60)).cast("long")) / F.lit(2.0**60)).alias("phi"))
    )
    return _shares(phi, segments)


def _shares(phi: DataFrame, segments: Sequence[str], *others: str) -> DataFrame:
    positive = F.greatest("phi", F.lit(0.0))
    total = steady_sum(positive, Window.partitionBy(*segments))
    return phi.select(
        *segments, "channel", "phi", *others,
        F.when(total > 0, positive / total).alias("share"),
        F.when(total <= 0, "no channel adds value").alias("reason"),
    )


def seen_channels(facts: DataFrame, channels: Sequence[str]) -> list[str]:
    """The declared channels that some journey has, in their order."""
    if len(channels) > MAX_DECLARED:
        raise ValueError(f"channel sets hold {MAX_DECLARED} channels")
    union = facts.agg(F.bit_or("channel_mask").alias("m")).first()["m"] or 0
    return [c for i, c in enumerate(channels) if union >> i & 1]


def _narrowed(facts: DataFrame, channels: Sequence[str], seen: Sequence[str]) -> DataFrame:
    """facts with masks over the ``seen`` channels only."""
    mask = F.lit(0).cast("long")
    for bit, channel in enumerate(seen):
        here = F.shiftright("channel_mask", channels.index(channel)).bitwiseAND(F.lit(1))
        mask = mask.bitwiseOR(F.shiftleft(here, bit))
    return facts.where(F.col("channel_mask").isNotNull()).withColumn("channel_mask", mask)


def shapley_credit(
    facts: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = (),
    max_exact: int = MAX_CHANNELS, blocks: int = BLOCKS,
) -> DataFrame:
    """(segment, channel, phi, standard_error, share, reason) for all declared channels, exact or sampled.

    ``standard_error`` is 0 where the value is exact.
    """
    segments, channels = list(segment_cols), list(channels)
    seen = seen_channels(facts, channels)
    narrow = _narrowed(facts, channels, seen)
    if len(seen) <= max_exact:
        values = coalition_values(narrow, seen, segments)
        phi = shapley_attribution(values, seen, segments).select(*segments, "channel", "phi", F.lit(0.0).alias("standard_error"))
    else:
        phi = sampled_shapley(channel_set_counts(narrow, segments), seen, segments, blocks)
    unseen = [c for c in channels if c not in seen]
    if unseen:
        absent = facts.select(*segments).distinct() if segments else facts.sparkSession.range(1).select()
        zeros = absent.select(*segments, F.explode(F.array(*map(F.lit, unseen))).alias("channel"), F.lit(0.0).alias("phi"), F.lit(0.0).alias("standard_error"))
        phi = phi.unionByName(zeros)
    return _shares(phi, segments, "standard_error")


def _orders(n: int, blocks: int, seed: int = 11) -> np.ndarray:
    """Place of each channel in each of blocks * n orders. In a block every channel has every place once."""
    rng = np.random.default_rng(seed)
    base = np.argsort(rng.random((blocks, n)), axis=1)
    return ((base[:, None, :] + np.arange(n)[None, :, None]) % n).reshape(blocks * n, n)


def sampled_shapley(
    counts: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = (), blocks: int = BLOCKS
) -> DataFrame:
    """(segment, channel, phi, standard_error) from random orders of the channels.

    ``counts`` are journeys and conversions per channel set. In an order, a set is complete when its last channel has
    come; a task adds its sets up by order and place, so what moves is orders x places per segment, however many
    sets there are. From the running sums come the values of all prefixes, and a channel's gain in each order.
    Orders are stratified: a block rotates one order through all places. Blocks are independent, and their spread
    gives the error. Each order's gains add up to the value of all channels.
    """
    segments, n = list(segment_cols), len(channels)
    places = _orders(n, blocks)
    key = [counts.schema[c] for c in segments]
    cell = T.StructType([
        *key, T.StructField("order", T.IntegerType()), T.StructField("place", T.IntegerType()),
        T.StructField("journeys", T.LongType()), T.StructField("conversions", T.LongType()),
    ])

    def completed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(segments, dropna=False, sort=False) if segments else [((), batch)]
            for name, rows in groups:
                masks = rows["channel_mask"].to_numpy(dtype=np.int64)
                member = (masks[:, None] >> np.arange(n)) & 1
                sums = np.zeros((2, len(places), n + 1), dtype=np.int64)
                measures = [rows[c].to_numpy(dtype=np.int64) for c in ("journeys", "conversions")]
                for order, place in enumerate(places):
                    last = (member * (place + 1)).max(axis=1)
                    for total, measure in zip(sums, measures):
                        np.add.at(total[order], last, measure)
                made = pd.DataFrame({
                    "order": np.repeat(np.arange(len(places), dtype=np.int32), n + 1),
                    "place": np.tile(np.arange(n + 1, dtype=np.int32), len(places)),
                    "journeys": sums[0].ravel(), "conversions": sums[1].ravel(),
                })
                for at, column in enumerate(segments):
                    made.insert(at, column, name[at])
                yield made

    cells = counts.select(*segments, "channel_mask", "journeys", "conversions").mapInPandas(completed, cell)
    cells = cells.groupBy(*segments, "order", "place").agg(F.sum("journeys").alias("journeys"), F.sum("conversions").alias("conversions"))

    def gains(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "place"])
        inside = rows["journeys"].to_numpy().reshape(len(places), n + 1).cumsum(axis=1)
        won = rows["conversions"].to_numpy().reshape(len(places), n + 1).cumsum(axis=1)
        value = np.divide(won, inside, out=np.zeros(won.shape), where=inside > 0)
        gain = np.take_along_axis(np.diff(value, axis=1), places, axis=1).reshape(blocks, n, n).mean(axis=1)
        error = gain.std(axis=0, ddof=1) / np.sqrt(blocks) if blocks > 1 else np.full(n, np.nan)
        made = pd.DataFrame({"channel": list(channels), "phi": gain.mean(axis=0), "standard_error": error})
        for at, column in enumerate(segments):
            made.insert(at, column, rows[column].iloc[0])
        return made

    out = T.StructType([
        *key, T.StructField("channel", T.StringType()), T.StructField("phi", T.DoubleType()), T.StructField("standard_error", T.DoubleType()),
    ])
    # A group has orders x places rows, whatever the number of journeys.
    return cells.groupBy(*segments).applyInPandas(gains, out)


def efficiency_residual(
    phi: DataFrame, values: DataFrame, channels: Sequence[str], segment_cols: Sequence[str] = ()
) -> DataFrame:
    """abs(sum of phi - (value of all channels - value of none)); 0 up to rounding."""
    segments = list(segment_cols)
    full = (1 << len(channels)) - 1
    none = F.lit(0.0)
    of_phi = phi.select(*segments, F.col("phi").alias("phi_part"), none.alias("value_part"))
    of_values = values.where(F.col("coalition").isin(0, full)).select(
        *segments, none.alias("phi_part"),
        F.when(F.col("coalition") == full, F.col("value")).otherwise(-F.col("value")).alias("value_part"),
    )
    return of_phi.unionByName(of_values).groupBy(*segments).agg(
        F.sum("phi_part").alias("phi_total"),
        F.sum("value_part").alias("value_spread"),
        F.abs(F.sum("phi_part") - F.sum("value_part")).alias("residual"),
    )
