"""Small hand-written inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

from touchtally.config import AttributionConfig
from touchtally.operators.journeys import build_touches
from touchtally.operators.rules import attribution_facts

DAY0 = datetime(2026, 6, 1)
CFG = AttributionConfig()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def touches(spark, rows):
    """Rows of (user_id, channel, ts); touch_id is the row number."""
    data = [(i, user, channel, when) for i, (user, channel, when) in enumerate(rows)]
    return spark.createDataFrame(data, "touch_id long, user_id long, channel string, ts timestamp_ntz")


def conversions(spark, rows):
    """Rows of (user_id, convert_ts[, revenue[, is_refunded]])."""
    data = [(*row, *(96.0, False)[len(row) - 2:]) for row in rows]
    return spark.createDataFrame(
        data, "user_id long, convert_ts timestamp_ntz, revenue double, is_refunded boolean"
    )


def sample(spark):
    """Users 11 and 12 buy; 13 and 14 do not."""
    rows = [
        (11, "email", ts("2026-05-03 06:00")), (11, "referral", ts("2026-05-05 18:00")), (11, "google", ts("2026-05-06 06:00")),
        (12, "google", ts("2026-05-10")), (12, "google", ts("2026-05-12")),
        (13, "meta", ts("2026-05-20")), (14, "tiktok", ts("2026-05-21")), (14, "email", ts("2026-05-22")),
    ]
    return touches(spark, rows), conversions(spark, [(11, ts("2026-05-07 06:00")), (12, ts("2026-05-13"))])


def from_specs(spark, specs, cfg=CFG):
    """Facts of journeys given as (channels, converts, copies)."""
    rows, bought, user = [], [], 0
    for channels, converts, copies in specs:
        for _ in range(copies):
            user += 1
            rows += [(user, c, DAY0 + timedelta(days=i)) for i, c in enumerate(channels)]
            if converts:
                bought.append((user, DAY0 + timedelta(days=len(channels))))
    return attribution_facts(build_touches(touches(spark, rows), conversions(spark, bought), cfg), cfg)


def moments_row(spark, **values):
    """One row per experiment with the given columns."""
    names = list(values)
    return spark.createDataFrame(
        [("exp", 0.05, *[float(values[n]) if not isinstance(values[n], int) else values[n] for n in names])],
        ["experiment_id", "alpha", *names],
    )
