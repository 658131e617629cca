"""Timestamp arithmetic on zone-less timestamps (session zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed full 24-hour periods, not the calendar-day difference."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY_MICROS)).cast("bigint")


def plus_days(ts: Column, days: Column | int) -> Column:
    amount = days if isinstance(days, Column) else F.lit(days)
    return ts + F.make_dt_interval(amount.cast("int"))


def minus_months(ts: Column, months: int) -> Column:
    """Calendar months back, clamped to the last day of a shorter month."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months))


def as_naive_utc(text: Column) -> Column:
    """Parse text with or without an offset; unparseable text gives null."""
    return text.try_cast("timestamp").cast("timestamp_ntz")
