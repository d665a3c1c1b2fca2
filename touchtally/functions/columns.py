"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _interval_micros(interval: Column) -> Column:
    """Microseconds of a day-time interval.

    Subtracting two zone-less timestamps does not look at the session time zone,
    where ``timestampdiff`` would.
    """
    seconds = interval.cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def epoch_micros(ts: Column) -> Column:
    return _interval_micros(ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def age_days(ts: Column, until: Column) -> Column:
    """Fractional days from ``ts`` to ``until``; NULL when either is NULL."""
    return _interval_micros(until - ts) / F.lit(float(MICROS_PER_DAY))


def calendar_days(ts: Column, until: Column) -> Column:
    """Midnights between ``ts`` and ``until``."""
    return F.datediff(until, ts)


def half_life_weight(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / F.lit(float(half_life)))


def net_of_refund(revenue: Column, is_refunded: Column) -> Column:
    return F.when(is_refunded, F.lit(0.0)).otherwise(revenue)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, NULL where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator)


def rate(flag: Column) -> Column:
    """Share of true rows; NULL counts as false."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def clip(value: Column, low: Column, high: Column) -> Column:
    """``value`` held between the bounds; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def bucket_hash(unit_id: Column, salt: Column | str) -> Column:
    """Salted SHA-256 of ``salt:unit_id`` mapped to [0, 1] by its first 64 bits."""
    salt_col = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.sha2(F.concat(salt_col, F.lit(":"), unit_id.cast("string")), 256)
    top64 = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return top64.cast("double") / F.lit(2.0**64)


# Type of exact totals: fixed-point numbers with 12 digits.
EXACT = "decimal(38,12)"


def exact_parts(value: str, name: str, whole: int = 6, rest: int = 6) -> list[Column]:
    """Two aggregates of longs that make an exact total, whatever the order of the rows.

    Each value counts in units of 10**-(whole + rest), its multiples of 10**-whole apart from the
    rest. The totals must fit a long in units of 10**-whole; there may be 9e18 / 10**rest rows.
    """
    high = f"floor(({value}) * 1e{whole})"
    return [
        F.expr(f"sum(bigint({high})) AS {name}__whole"),
        F.expr(f"sum(bigint(round((({value}) * 1e{whole} - {high}) * 1e{rest}))) AS {name}__rest"),
    ]


def exact_total(name: str, whole: int = 6, rest: int = 6) -> str:
    """SQL for the ``EXACT`` total of ``exact_parts``."""
    return (
        f"CAST(CAST({name}__whole AS decimal(20,0)) * CAST('1e-{whole}' AS decimal({whole},{whole})) "
        f"+ CAST({name}__rest AS decimal(20,0)) * CAST('1e-{whole + rest}' AS decimal({whole + rest},{whole + rest})) AS {EXACT})"
    )


# Money counts in cents and 10**-9, so that totals may reach 9e16; shares of one in 10**-6 and 10**-12.
MONEY = (2, 7)


def steady_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """Sum of a few doubles that doesn't depend on their order."""
    total = F.sum(value.cast("decimal(38,15)"))
    return (total if window is None else total.over(window)).cast("double")


def for_reading(value: Column | str, digits: int) -> Column:
    """Rounded; finer first, because sums of thirds lie just beside the value that they stand for."""
    return F.round(F.round(value, digits + 6), digits)


def derive(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """Add columns in one projection; later ones may refer to earlier ones by name.

    A text value is an SQL expression.
    """
    return df.select("*", *[
        F.expr(f"{value} AS {name}") if isinstance(value, str) else value.alias(name)
        for name, value in columns.items()
    ])
