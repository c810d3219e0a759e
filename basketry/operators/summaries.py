"""Quantile summaries as a table: one scan of the rows, then many questions.

A summary has one row per group with a mergeable sketch of every column. Coarser groups come from merging its
rows, so a table by state and score answers for states, for scores and for everything. Estimates are read
from it directly; ``quantiles.exact_quantiles(..., summary=...)`` takes the brackets of its exact ranks from it.
Sketches draw random bits, so a summary differs from run to run; exact quantiles do not.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Accuracy parameter of the sketches; one of a large group has about 100 KB.
SIZE = 4096
# Fixed values of these sketches: the rank error that 99 % of the answers keep is FACTOR / size ** POWER.
FACTOR, POWER = 2.446, 0.9433
# Half width of a bracket in units of that error.
MARGIN = 2.0
# Half widths to choose from: a sketch is asked for ranks that do not depend on the row.
HALVES = tuple(2.0**-j for j in range(20))


def quantile_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """One row per group: ``<column>_n`` values that are not null, ``<column>_kll`` their sketch, and the sketch size.

    A null key is a group like any other, for its rows count when that key is merged away. Without keys there is
    one row, also for an empty table. The rows are combined before the exchange, so what is shuffled are sketches.
    """
    values = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    found = values.groupBy(*by).agg(
        *(F.count(c).alias(f"{c}_n") for c in columns),
        *(F.kll_sketch_agg_double(c, size).alias(f"{c}_kll") for c in columns),
    )
    return found.withColumn("summary_size", F.lit(size))


def merged(summary: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The summary of coarser groups: rows that agree in the keys ``by`` become one."""
    # a group without a value has nothing to merge
    sketches = {c: F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_kll")) for c in columns}
    return summary.groupBy(*by).agg(
        *(F.coalesce(F.sum(f"{c}_n"), F.lit(0)).cast("bigint").alias(f"{c}_n") for c in columns),
        *(F.kll_merge_agg_double(sketches[c]).alias(f"{c}_kll") for c in columns),
        F.min("summary_size").alias("summary_size"),
    )


def rank_error() -> Column:
    """The share of a group's rows by which a sketch may miss a rank."""
    return FACTOR / F.pow(F.col("summary_size").cast("double"), F.lit(POWER))


def _values_at(column: str, shares: Sequence[float]) -> Column:
    places = F.array(*(F.lit(min(max(float(p), 0.0), 1.0)) for p in shares))
    return F.when(F.col(f"{column}_n") > 0, F.kll_sketch_get_quantile_double(f"{column}_kll", places))


def estimates(summary: DataFrame, targets: Mapping[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Per group an estimate of every target, ``{name: (column, probability)}``, and the rank error they keep."""
    coarse = merged(summary, by, list(dict.fromkeys(c for c, _ in targets.values())))
    found = {name: _values_at(c, [p])[0] for name, (c, p) in targets.items()}
    return coarse.select(*by, *(v.alias(name) for name, v in found.items()), rank_error().alias("rank_error"))


def brackets(summary: DataFrame, targets: Sequence[tuple[str, float]], by: Sequence[str], wider: float = 1.0) -> DataFrame:
    """Per group: for target i two values around its rank, ``_low_i`` and ``_high_i``, and the rank ``_rank_i``.

    ``_expected`` is about the number of rows in the widest bracket. With an endless ``wider`` a bracket is the whole column.
    """
    endless = wider == float("inf")
    parts, expected = [], [F.lit(0.0)]
    for i, (c, p) in enumerate(targets):
        n = F.col(f"{c}_n")
        # one rank for the neighbour of the target and one for rounding, besides the error
        need = rank_error() * MARGIN * min(wider, 1e9) + F.try_divide(F.lit(2.0), n)
        chosen = F.greatest(F.least(F.floor(-F.log2(need)), F.lit(len(HALVES) - 1)), F.lit(0)).cast("int")
        low = F.lit(float("-inf")) if endless else F.get(_values_at(c, [p - h for h in HALVES]), chosen)
        high = F.lit(float("inf")) if endless else F.get(_values_at(c, [p + h for h in HALVES]), chosen)
        rank = F.when(n > 0, p * (n - 1).cast("double"))
        parts += [low.alias(f"_low_{i}"), high.alias(f"_high_{i}"), rank.alias(f"_rank_{i}")]
        share = F.lit(1.0) if endless else F.least(2 * F.pow(F.lit(2.0), -chosen), F.lit(1.0))
        expected.append(n * share)
    return summary.select(*by, F.greatest(*expected).alias("_expected"), *parts)
