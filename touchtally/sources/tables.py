"""Readers and writers of the raw tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchtally.sources.checkpoints import local_rows
from touchtally.sources.schemas import EXPERIMENT_CONFIG, TABLES

_EXPERIMENT_COLUMNS = (
    "user_id", "variant", "primary_metric", "pre_covariate",
    "guardrail_refund", "guardrail_latency_ms",
)
# Fixed defaults of an experiment's settings.
EXPERIMENT_DEFAULTS = {
    "control_share": 0.5,
    "alpha": 0.05,
    "refund_margin_relative": 0.5,
    "latency_margin": 25.0,
    "looks": [0.2, 0.4, 0.6, 0.8, 1.0],
    "spending": "obrien_fleming",
    "current_look": 5,
}


def conform(df: DataFrame, table: str, required: Iterable[str] | None = None) -> DataFrame:
    """Project ``df`` to the declared columns of ``table``, in declared types.

    Columns outside ``required`` may be missing and are then left out. A missing
    required column is an error when the plan is built, not when it runs.
    """
    schema = TABLES[table]
    needed = set(schema.names if required is None else required)
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ValueError(f"table {table!r} lacks columns {missing}")
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns]
    )


def read_table(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Scan a raw table under ``root``, checked against its declared schema."""
    return conform(spark.read.format(fmt).load(f"{root.rstrip('/')}/{table}"), table)


def write_table(df: DataFrame, root: str, table: str, partition_by: Iterable[str] = ()) -> None:
    """Replace a raw table under ``root`` with ``df``."""
    writer = conform(df, table).write.mode("overwrite")
    keys = list(partition_by)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(f"{root.rstrip('/')}/{table}")


def load_experiment(assignments: DataFrame, experiment_id: str) -> DataFrame:
    """Rows of one experiment; the filter reaches the scan."""
    return assignments.where(F.col("experiment_id") == experiment_id).select(*_EXPERIMENT_COLUMNS)


def require_rows(df: DataFrame, experiment_id: str) -> DataFrame:
    """Raise when ``df`` has no rows. Reads one row."""
    if df.isEmpty():
        raise ValueError(f"experiment {experiment_id!r} has no rows")
    return df


def missing_experiments(assignments: DataFrame, config: DataFrame) -> DataFrame:
    """Configured experiments without any assigned unit."""
    seen = assignments.groupBy("experiment_id").agg(F.count("*").alias("units"))
    return config.select("experiment_id").join(seen, "experiment_id", "left_anti")


def load_ground_truth(spark: SparkSession, path: str, field: str = "channel_importance_true") -> DataFrame:
    """``(channel, true_share)`` from a JSON document holding a name-to-share object."""
    document = spark.read.option("multiLine", True).json(path)
    if field not in document.columns:
        raise ValueError(f"{path} has no field {field!r}")
    shares = document.select(f"{field}.*")
    return shares.unpivot([], shares.columns, "channel", "true_share").select(
        "channel", F.col("true_share").cast("double").alias("true_share")
    )


def experiment_config(spark: SparkSession, settings: list[dict]) -> DataFrame:
    """Per-experiment settings as a DataFrame; absent keys take the defaults."""
    rows = []
    for given in settings:
        row = {**EXPERIMENT_DEFAULTS, **given}
        if not 0.0 <= row["control_share"] <= 1.0:
            raise ValueError(f"control_share outside [0, 1]: {row['control_share']}")
        if not 0.0 < row["alpha"] < 1.0:
            raise ValueError(f"alpha outside (0, 1): {row['alpha']}")
        rows.append(tuple(row[f.name] for f in EXPERIMENT_CONFIG))
    return local_rows(spark, rows, EXPERIMENT_CONFIG)
