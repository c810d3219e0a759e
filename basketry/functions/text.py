"""Text renderings used in report tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_currency(c: Column | str) -> Column:
    return F.concat(F.lit("R$ "), F.format_number(_col(c), 2))


def format_fixed(c: Column | str, digits: int = 2) -> Column:
    # format_number rounds the binary value half to even; format_string would round half up
    return F.translate(F.format_number(_col(c), digits), ",", "")


def format_percent(c: Column | str, digits: int = 2) -> Column:
    return F.concat(format_fixed(_col(c) * 100, digits), F.lit("%"))


def abbreviate_id(c: Column | str, keep: int = 6) -> Column:
    return F.concat(F.substring(_col(c).cast("string"), 1, keep), F.lit("..."))
