"""Totals of the wide view without its rows.

In the wide view every item of an order stands beside every payment and every review of it. The rows of an
order are the product of the counts on the three sides, and a sum over one side's column is that side's sum
times the counts of the others. So each side is added up by itself, to one row per order (and group key of that
side), and only these rows are joined.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.operators.filters import known
from basketry.operators.joins import SalesTables, order_heads, order_lines

ORDER = "order_id"


def merged_totals(
    tables: SalesTables,
    keys: Sequence[str],
    sums: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Per group of the wide view its rows, different orders, and sums; groups with a missing key are dropped.

    ``sums`` maps an output name to a column and the type it is added up in. Keys and columns are those of
    the tables themselves; columns that are derived from several tables raise.
    """
    sides = {
        "heads": order_heads(tables),
        "lines": order_lines(tables),
        "payments": tables.payments,
        "reviews": tables.order_reviews,
    }
    owner = {c: _owner(sides, c) for c in [*keys, *(c for c, _ in sums.values())]}
    parts = []
    for name, side in sides.items():
        own = [k for k in keys if owner[k] == name and k != ORDER]
        totals = [F.sum(F.col(c).cast(kind)).alias(f"_sum_{out}") for out, (c, kind) in sums.items() if owner[c] == name]
        # order ids are unique among the heads by their key, but nothing here relies on it
        parts.append(known(side, ORDER, *own).groupBy(ORDER, *own).agg(F.count(F.lit(1)).alias(f"_rows_{name}"), *totals))
    joined = reduce(lambda a, b: a.join(b, ORDER), parts)

    def times(names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a * b, (F.col(f"_rows_{n}") for n in names))

    # one row per order and combination of its keys
    rows = joined.select(
        ORDER,
        *(k for k in keys if k != ORDER),
        times(list(sides)).alias("merged_rows"),
        *(_scaled(out, kind, times([n for n in sides if n != owner[c]])) for out, (c, kind) in sums.items()),
    )
    if list(keys) == [ORDER]:
        return rows
    per_order = rows.groupBy(ORDER, *keys).agg(F.sum("merged_rows").alias("merged_rows"), *(F.sum(o).alias(o) for o in sums))
    return per_order.groupBy(*keys).agg(
        F.sum("merged_rows").alias("merged_rows"),
        F.count(F.lit(1)).alias("order_count"),
        *(F.sum(o).alias(o) for o in sums),
    )


def _scaled(out: str, kind: str, copies: Column) -> Column:
    total = F.col(f"_sum_{out}")
    if kind.startswith("decimal"):
        scale = kind.rstrip(")").rpartition(",")[2]
        return (total * copies.cast("decimal(18,0)")).cast(f"decimal(38,{scale})").alias(out)
    return (total * copies).alias(out)


def _owner(sides: Mapping[str, DataFrame], column: str) -> str:
    for name, side in sides.items():
        if side is not None and column in side.columns:
            return name
    raise ValueError(f"{column} is in none of the joined tables")
