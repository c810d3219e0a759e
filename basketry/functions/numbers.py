"""Sums and means whose result does not depend on the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


MEASURE_SCALE = 12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c: Column | str, scale: int) -> Column:
    """Sum in decimal arithmetic; an empty or all-null group sums to 0."""
    total = F.sum(_col(c).cast(f"decimal(18,{scale})"))
    return F.coalesce(total.cast("double"), F.lit(0.0))


def exact_mean(c: Column | str, scale: int = 4) -> Column:
    """Mean in decimal arithmetic; null for an all-null group.

    ``scale`` must keep every digit that counts: 4 for money, MEASURE_SCALE for values that are means themselves.
    """
    width = 18 if scale <= 4 else 38
    total = F.sum(_col(c).cast(f"decimal({width},{scale})")).cast("double")
    return F.try_divide(total, F.count(_col(c)).cast("double"))


def money_sum(c: Column | str) -> Column:
    return exact_sum(c, 2)


def money_mean(c: Column | str) -> Column:
    return exact_mean(c, 4)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Division that gives null when the whole is zero."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def round_digits(c: Column | str, digits: int = 6) -> Column:
    """Round half to even, the rule of numeric array libraries."""
    return F.bround(_col(c), digits)


def all_known(*columns: str) -> Column:
    """None of the columns is null. Unlike a row-wise count of nulls, this reaches the scan."""
    known = F.lit(True)
    for i, c in enumerate(columns):
        known = F.col(c).isNotNull() if i == 0 else known & F.col(c).isNotNull()
    return known
