"""Types of text columns from all their values.

A column's type is the narrowest of whole number, decimal number, time and text that fits every value it has.
How many values fit each is counted in one aggregate over all splits, so no sample and no order of rows decides, and
missing values do not widen a type: whole numbers with gaps stay whole numbers.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from basketry.sources.schemas import NULL_TOKENS, REAL

# A number with leading zeros is a code: as a number it would lose them.
WHOLE = r"^[+-]?(0|[1-9][0-9]{0,17})$"
NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?$"
INT_LIMIT = 2**31


def _fits(text: Column) -> dict[str, Column]:
    """Aggregates over one column: its values, those of each kind, and the largest whole number."""
    whole = text.rlike(WHOLE)
    return {
        "filled": F.count(text),
        "whole": F.count_if(whole),
        "number": F.count_if(text.rlike(NUMBER)),
        "time": F.count_if(text.rlike(TIME) & text.try_cast("timestamp_ntz").isNotNull()),
        "largest": F.max(F.when(whole, F.abs(text.try_cast("bigint")))),
    }


def inferred_types(raw: DataFrame, null_tokens: Iterable[str] = NULL_TOKENS) -> dict[str, str]:
    """Column to type for a frame of text columns, in one pass; a column without values is text."""
    tokens = tuple(null_tokens)
    entries = [
        F.struct(*(a.alias(n) for n, a in _fits(F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`"))).items()))
        for c in raw.columns
    ]
    found = raw.agg(F.array(*entries)).first()[0] if entries else []
    return {c: _type(row) for c, row in zip(raw.columns, found)}


def _type(row) -> str:
    if not row.filled:
        return "string"
    if row.whole == row.filled:
        return "int" if row.largest < INT_LIMIT else "bigint"
    if row.number == row.filled:
        return REAL
    return "timestamp_ntz" if row.time == row.filled else "string"
