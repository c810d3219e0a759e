"""Timestamp expressions. All of them are independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(text: Column | str, strict: bool = True) -> Column:
    """Text to a zone-less timestamp; bad text raises, or gives null when not strict."""
    if strict:
        return F.to_timestamp_ntz(_col(text))
    return _col(text).try_cast("timestamp_ntz")


def subtract(end: Column | str, start: Column | str) -> Column:
    """Difference of two timestamps as a day-time interval."""
    return _col(end) - _col(start)


def add_seconds(ts: Column | str, seconds: Column) -> Column:
    zero = F.lit(0)
    return _col(ts) + F.make_dt_interval(zero, zero, zero, seconds)


def elapsed_days(end: Column | str, start: Column | str) -> Column:
    """Whole days from start to end, floored towards minus infinity.

    The day field of an interval truncates towards zero, so one day is taken off when the
    interval lies below its own truncation.
    """
    gap = subtract(end, start)
    days = F.extract(F.lit("DAY"), gap)
    return F.when(gap < F.make_dt_interval(days), days - 1).otherwise(days).cast("bigint")


def late_flag(delivered: Column | str, estimated: Column | str) -> Column:
    """1 when delivered after the estimate, 0 otherwise and when either is missing."""
    return F.coalesce((_col(delivered) > _col(estimated)).cast("int"), F.lit(0))


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts).cast("date"), "yyyy-MM")


def day_of_week(ts: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return (F.weekday(_col(ts)) + 1).cast("int")
