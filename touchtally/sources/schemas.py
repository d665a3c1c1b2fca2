"""Declared schemas of the raw tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_STRING, _BOOL, _TS, _DATE = T.StringType(), T.BooleanType(), T.TimestampNTZType(), T.DateType()

# Table and column names and types.
TABLES: dict[str, T.StructType] = {
    "users": _schema(
        ("user_id", _LONG), ("signup_ts", _TS), ("platform", _STRING),
        ("country", _STRING), ("acquisition_cohort", _STRING),
    ),
    "touchpoints": _schema(
        ("touch_id", _LONG), ("user_id", _LONG), ("channel", _STRING),
        ("campaign", _STRING), ("ts", _TS), ("cost_attributed", _DOUBLE),
        ("position_in_journey", _INT),
    ),
    "conversions": _schema(
        ("conversion_id", _LONG), ("user_id", _LONG), ("convert_ts", _TS),
        ("plan_type", _STRING), ("revenue", _DOUBLE), ("is_refunded", _BOOL),
        ("refund_ts", _TS),
    ),
    "spend": _schema(
        ("date", _DATE), ("channel", _STRING), ("campaign", _STRING),
        ("spend", _DOUBLE), ("impressions", _LONG), ("clicks", _LONG),
    ),
    "experiment_assignment": _schema(
        ("user_id", _LONG), ("experiment_id", _STRING), ("variant", _STRING),
        ("assign_ts", _TS), ("bucketing_hash", _DOUBLE), ("pre_covariate", _DOUBLE),
        ("primary_metric", _DOUBLE), ("guardrail_refund", _BOOL),
        ("guardrail_latency_ms", _DOUBLE),
    ),
}

EXPERIMENT_CONFIG = T.StructType([
    T.StructField("experiment_id", _STRING, False),
    T.StructField("salt", _STRING, False),
    T.StructField("control_share", _DOUBLE, False),
    T.StructField("practical_threshold", _DOUBLE, False),
    T.StructField("alpha", _DOUBLE, False),
    T.StructField("refund_margin_relative", _DOUBLE, False),
    T.StructField("latency_margin", _DOUBLE, False),
    T.StructField("looks", T.ArrayType(_DOUBLE, False), False),
    T.StructField("spending", _STRING, False),
    T.StructField("current_look", _INT, False),
])
