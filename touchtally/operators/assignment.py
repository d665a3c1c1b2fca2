"""Salted-hash assignment as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchtally.functions.columns import bucket_hash


def two_way_variant(bucket: Column, control_share: Column | float) -> Column:
    return F.when(bucket < control_share, F.lit("control")).otherwise(F.lit("treatment"))


def assign(df: DataFrame, salt: Column | str, control_share: float = 0.5, unit: str = "user_id") -> DataFrame:
    """Add ``bucketing_hash`` and ``variant``; control gets hashes below the share."""
    if not 0.0 <= control_share <= 1.0:
        raise ValueError(f"control_share outside [0, 1]: {control_share}")
    return df.withColumn("bucketing_hash", bucket_hash(F.col(unit), salt)).withColumn(
        "variant", two_way_variant(F.col("bucketing_hash"), control_share)
    )


def assign_multivariate(
    df: DataFrame, salt: Column | str, variants: Sequence[tuple[str, float]], unit: str = "user_id"
) -> DataFrame:
    """Add ``bucketing_hash`` and ``variant`` for any number of weighted arms."""
    weights = [weight for _, weight in variants]
    if not variants or any(w < 0 for w in weights) or abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("variant weights must be non-negative and add up to 1")
    hashed = df.withColumn("bucketing_hash", bucket_hash(F.col(unit), salt))
    chosen = F.lit(variants[-1][0])
    # Built from the last arm down, so that the lowest edge above the hash wins.
    for i in range(len(variants) - 2, -1, -1):
        chosen = F.when(F.col("bucketing_hash") < sum(weights[: i + 1]), F.lit(variants[i][0])).otherwise(chosen)
    return hashed.withColumn("variant", chosen)


def observed_split(assignments: DataFrame) -> DataFrame:
    """Share of units in control, per experiment."""
    return assignments.groupBy("experiment_id").agg(
        F.avg(F.when(F.col("variant") == "control", 1.0).otherwise(0.0)).alias("control_share")
    )
