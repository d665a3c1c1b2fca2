"""Ranks inside groups of any size, by a range sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchtally.sources.checkpoints import broadcast_if_small, local_rows, materialise


def ranked(
    rows: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "rank", few_groups: bool = False
) -> DataFrame:
    """rows with their rank from 1 in the order inside their group; rows equal in all of it come in any order.

    A window would sort a whole group in one task. Here rows are dealt by range, so a large group is in many
    tasks; ranks come from the row's place in its task, the counts of the tasks before, and the group's first place.
    The sorted rows are written, so that retried tasks find the same places. ``few_groups`` says that the groups are few
    enough to broadcast a row for each; else they are counted.
    """
    sort = [*groups, *order]
    placed = materialise(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_id", 33))
    counts = placed.groupBy("_task").agg(F.count("*").alias("n")).orderBy("_task").collect()
    before, starts = 0, []
    for row in counts:
        starts.append((row["_task"], before))
        before += row["n"]
    # One row per task of the sort.
    starts = F.broadcast(local_rows(rows.sparkSession, starts, T.StructType().add("_task", "long").add("_before", "long")))
    placed = placed.join(starts, "_task").withColumn("_at", F.col("_before") + F.col("_id").bitwiseAND(F.lit(2**33 - 1)))
    firsts = placed.groupBy(*groups).agg(F.min("_at").alias("_first"))
    firsts = F.broadcast(firsts) if few_groups else broadcast_if_small(materialise(firsts))
    return (
        placed.join(firsts, list(groups))
        .withColumn(name, F.col("_at") - F.col("_first") + 1)
        .drop("_id", "_task", "_before", "_at", "_first")
    )
