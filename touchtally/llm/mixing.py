"""Mixing sources to target weights by Pareto order sampling.

A source with target T and size S is taken T / S times over. The whole part is
certain: every document gets that many copies. The rest is the inclusion
probability p of one more copy, drawn by Pareto order sampling: documents are ranked
by the odds of a random number divided by the odds of p, and the ranking is cut where
the words taken reach the source's target, so the sample size is fixed in words.

The random number comes from the document id and a seed: reruns and retries agree.
The cut is found from counts, in two steps: sums per (source, rank bucket), then an
exact ranking inside the one bucket per source in which the target falls. It is
then a predicate on the row, so texts are never shuffled.

Cases: null text has size 0; null source is a source of its own, last in order; a
source of size 0 gets target 0; rows equal in id and size are in or out together;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.llm.common import written
from touchtally.sources.checkpoints import broadcast_if_small

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = "mix-1"
RANK_BUCKETS = 4096


def random_unit(key: str, seed: str) -> Column:
    """A number in (0, 1) with 52 bits, from a key column and a seed."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sized: DataFrame, weights: Sequence[float], max_repeat: int, source: str = "source") -> DataFrame:
    """One row per source: source, source_size, target.

    Weights repeat over the sources in order. The excess over ``max_repeat`` times
    a source's size goes to the others by weight until none is above: with sources
    in order of cap / weight, the level is (total - caps before) / (weights from here)
    at the first source whose cap it does not reach. The windows run over one row per source.
    """
    per = sized.groupBy(source).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col(source).isNull(), F.col(source))
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).isNull(), F.col(source))
    upto, whole = rising.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    levels = weighed.withColumns({
        "caps_before": F.sum("cap").over(upto) - F.col("cap"),
        "weights_from": F.sum("weight").over(whole) - F.sum("weight").over(upto) + F.col("weight"),
        "total": F.sum(F.col("source_size").cast("double")).over(whole),
    }).withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_from"))
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    return levels.withColumn("level", F.max(free).over(whole)).select(
        source, "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target")
    )


def mix_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT,
             seed: str = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per source with its target, certain copies and the rank at which sampling stops."""
    sized = sized.select(key, source, "size")
    targets = written(
        source_targets(sized, weights, max_repeat, source)
        .withColumn("_certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("_share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("_certain")).otherwise(0.0))
        .withColumn("_rest", F.col("target") - F.col("_certain") * F.col("source_size")),
        "mix-targets",
    )
    ranked = _ranked(sized, targets, seed, key, source).withColumn("bucket", F.floor(F.col("_rank") * RANK_BUCKETS))
    sums = ranked.groupBy(source, "bucket").agg(F.sum("size").alias("words"), F.first("_rest").alias("_rest"))
    along = Window.partitionBy(source).orderBy("bucket")
    edges = written(
        sums.withColumn("before", F.sum("words").over(along) - F.col("words"))
        .filter((F.col("before") <= F.col("_rest")) & (F.col("before") + F.col("words") > F.col("_rest")))
        .select(source, "bucket", "before"),
        "mix-edges",
    ).select(F.col(source).alias("edge_source"), F.col("bucket").alias("edge"), "before")
    inside = ranked.join(
        broadcast_if_small(edges), F.col(source).eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("edge"))
    )
    inner = Window.partitionBy(source).orderBy("_rank", "size").rangeBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("upto", F.col("before") + F.sum("size").over(inner))
    cut = F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("_rest"), F.struct("_rank", "size")))
    cuts = reached.groupBy("edge_source").agg(
        F.coalesce(cut, F.struct((F.min("edge") / RANK_BUCKETS).alias("_rank"), F.lit(-1).cast("long").alias("size"))).alias("_cut")
    )
    # Without an edge the rest is 0 or all: sources at the cap, or rounding of the target.
    everything = F.when(F.col("_rest") > 0, F.struct(F.lit(2.0).alias("_rank"), F.lit(0).cast("long").alias("size"))).otherwise(
        F.struct(F.lit(-1.0).alias("_rank"), F.lit(0).cast("long").alias("size"))
    )
    plan = targets.join(cuts, F.col(source).eqNullSafe(F.col("edge_source")), "left")
    return written(
        plan.select(source, "source_size", "target", "_certain", "_share", "_rest", F.coalesce("_cut", everything).alias("_cut")),
        "mix-plan",
    )


def _ranked(df: DataFrame, per_source: DataFrame, seed: str, key: str, source: str) -> DataFrame:
    """Rows with what their source has, and ``rank``: the odds ratio x as x / (1 + x), in (0, 1)."""
    own = broadcast_if_small(per_source.withColumnRenamed(source, "_source"))
    joined = df.join(own, F.col(source).eqNullSafe(F.col("_source"))).drop("_source").withColumn("_u", random_unit(key, seed))
    odds, by = F.col("_u") / (1 - F.col("_u")), F.col("_share") / (1 - F.col("_share"))
    return joined.withColumn("_rank", F.when(F.col("_share") > 0, odds / (odds + by)).otherwise(1.0)).drop("_u")


def apply_mix(sized: DataFrame, plan: DataFrame, seed: str = SEED, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Adds source_size, target, copies and taken to every row that has ``size``."""
    sized = sized.drop("source_size", "target", "copies", "taken")
    ranked = _ranked(sized, plan, seed, key, source)
    more = ((F.col("_share") > 0) & (F.struct("_rank", "size") <= F.col("_cut"))).cast("long")
    out = ranked.withColumn("copies", F.col("_certain") + more)
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_certain", "_share", "_rest", "_cut", "_rank")
