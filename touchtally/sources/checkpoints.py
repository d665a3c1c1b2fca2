"""Cutting lineage in the shared folder the cluster names, and checked broadcasts."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Largest per-experiment table that is broadcast.
MAX_BROADCAST_ROWS = 100_000


def _ensure_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return
    if sc.getCheckpointDir():
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="touchtally-checkpoint-"))


def materialise(df: DataFrame) -> DataFrame:
    """Run ``df`` once and read it back from reliable storage.

    Meant for small summaries that several branches of one plan read. The copy
    survives lost executors, because it is in the checkpoint folder.
    """
    _ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A DataFrame of rows that the driver has.

    Sent as Arrow, it is a local relation; a list of rows would be unpickled by a Python worker on every core, each time it is read.
    """
    for field, values in zip(schema, zip(*rows)):
        if not field.nullable and None in values:
            raise ValueError(f"null in {field.name}")
    arrays = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(to_arrow_schema(schema).types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=to_arrow_schema(schema)), schema)


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether ``df``, settings or an already written summary, has at most ``max_rows`` rows; counts up to the limit."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows; else leave the join alone.

    Counts ``df`` up to the limit, so give it settings or an already written
    summary. Without the hint the join is a sort-merge join, where adaptive
    execution splits skewed keys.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df
