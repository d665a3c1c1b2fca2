"""Slices for users whose touches are too many for one task.

Order matters only inside a user's journey. For most users one window per user is fine.
A user with more touches than ``rows_per_slice`` is cut into slices that are ordered
independently and joined again by the operators. Cuts are places in the order
(ts, touch_id), so a burst, and even a single timestamp, is cut like anything else; only
touches equal in both stay together.

Cuts come from a sample that a hash of the touch picks, so they are quantiles of the user's
touches, and a slice holds about ``rows_per_slice`` of them. The slice of a touch is
a comparison with the written cuts: every branch of a plan and every retried task finds the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchtally.sources.checkpoints import materialise

# Sampled touches that a slice spans.
SAMPLES_PER_SLICE = 64
# Bounds of the lists that are broadcast.
MAX_HEAVY_USERS = 100_000
MAX_CUTS = 200_000
# Cuts are kept in lists of this length, so that a place is found in two short searches.
_CUTS_PER_LIST = 256


def user_cuts(touches: DataFrame, rows_per_slice: int) -> DataFrame | None:
    """(user_id, cuts) of users with about ``rows_per_slice`` touches or more, written; None if there are none.

    One read of the log finds users and cuts. This only decides how a user's touches are
    spread over tasks, never which are used. However large the log, fewer than ``MAX_HEAVY_USERS`` users and
    about ``MAX_CUTS`` cuts come out, because the thresholds rise with the sample; so both may be broadcast.
    """
    step = max(1, rows_per_slice // SAMPLES_PER_SLICE)
    span = rows_per_slice // step
    picked = touches.select("user_id", "ts", "touch_id")
    if step > 1:
        picked = picked.where(F.expr(f"pmod(xxhash64(user_id, ts, touch_id), {step}) = 0"))
    picked = materialise(picked)
    counts = picked.groupBy("user_id").agg(F.count("*").alias("n"))
    floor = counts.agg(F.coalesce(F.expr(f"sum(n) div {MAX_HEAVY_USERS}"), F.lit(0))).scalar()
    heavy = materialise(counts.where(F.col("n") > F.greatest(F.lit(span), floor)))
    if heavy.isEmpty():
        return None
    apart = heavy.agg(F.greatest(F.lit(span), F.expr(f"sum(n) div {MAX_CUTS}"))).scalar()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "touch_id"))
    at = F.col("place") / F.col("apart")
    cuts = (
        picked.join(F.broadcast(heavy), "user_id")
        .withColumn("place", place)
        .withColumn("apart", apart)
        .where((F.col("place") % F.col("apart") == 0) & (F.col("place") < F.col("n")))
        .groupBy("user_id", F.floor((at - 1) / _CUTS_PER_LIST).alias("list"))
        .agg(F.array_sort(F.collect_set(F.struct("ts", "touch_id"))).alias("cuts"))
    )
    lists = F.array_sort(F.collect_list(F.struct("list", "cuts")))
    return materialise(cuts.groupBy("user_id").agg(F.transform(lists, lambda x: x["cuts"]).alias("cuts")))


def slice_number() -> Column:
    """Slice of a touch with ``ts``, ``touch_id`` and its user's ``cuts``: 0 without cuts, else from 1, rising in order."""
    here = F.struct("ts", "touch_id")
    passed = F.size(F.filter("cuts", lambda part: part[0] <= here))
    inside = F.size(F.filter(F.get("cuts", F.greatest(passed, F.lit(1)) - 1), lambda cut: cut <= here))
    number = F.greatest(passed - 1, F.lit(0)) * _CUTS_PER_LIST + inside + 1
    return F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(number).cast("long")


def slice_numbers() -> Column:
    """All numbers that ``slice_number`` can give a user with these ``cuts``."""
    most = (F.size("cuts") - 1) * _CUTS_PER_LIST + F.size(F.element_at("cuts", -1)) + 1
    return F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), most)).cast("array<long>")
