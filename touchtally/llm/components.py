"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregates and joins on node ids; nothing is collected. A hot node is
one side of an inner join whose other side has one row per node, which adaptive
execution splits. Rounds stop when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchtally.llm.common import last_table_only, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links are (a, b) with a > b. Large: larger neighbours move to the smallest neighbour; small: the rest do."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        moved = both.join(low, F.col("a") == F.col("node")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        moved = (
            links.join(low, F.col("a") == F.col("node"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
        )
    return moved.filter(F.col("a") > F.col("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of a link; loops and nulls are left out."""
    with last_table_only(links.sparkSession):
        current = written(
            links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
        )
        state = _state(current)
        for _ in range(max_rounds):
            current = written(_star(_star(current, True), False), "links")
            new = _state(current)
            if new == state:
                break
            state = new
        else:
            raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
