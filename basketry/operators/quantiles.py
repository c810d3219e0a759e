"""Exact interpolated quantiles without sorting or collecting a group.

A quantile sketch gives, for every group and target, two values that enclose the wanted rank.
One more scan counts the rows below that bracket and the different values inside it. The bracket
holds about 4 / accuracy of the rows of a group, so neither a group nor the column ever meets in
one task, and the rows themselves are never shuffled. The sketch can come from a summary table (``summaries``)
instead, which answers many questions with one scan.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions import all_known
from basketry.operators import summaries
from basketry.operators.sizing import small_side

ACCURACY = 10_000
# Half widths of a bracket, in units of the sketch's error. Large groups use the first; a group of
# few rows needs a larger share of them to hold the two values around its target.
MARGINS = (2, 10, 100, 1000)
# Brackets expected to hold more rows than this are narrowed, each time to about 4 / GRID of them.
BRACKET_ROWS = 1_000_000
# How much wider than their margins brackets get if a rank was missed; the last is the whole column.
WIDER = (1.0, 10.0, 100.0, float("inf"))
GRID = 200


def _sketch(
    df: DataFrame, targets: Sequence[tuple[str, float]], by: list[str], accuracy: int, wider: float = 1.0
) -> DataFrame:
    """Per group: for target i the bracket ends ``_low_i`` and ``_high_i`` and its ``_rank_i``.

    Ranks count from 0 among the values of the column, ``(n - 1) * p`` as in linear interpolation.
    """
    columns = list(dict.fromkeys(c for c, _ in targets))
    ends = {
        c: [
            min(max(p + s * m * wider / accuracy, 0.0), 1.0)
            for t, p in targets if t == c
            for m in MARGINS
            for s in (-1, 1)
        ]
        for c in columns
    }
    values = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    found = known_keys(values, by).groupBy(*by).agg(
        *(F.count(c).alias(f"_n_{c}") for c in columns),
        *(F.percentile_approx(c, ends[c], accuracy).alias(f"_ends_{c}") for c in columns),
    )

    def bracket(c: str, start: int, everything: float) -> Column:
        """The end at the narrowest margin that the group is large enough for."""
        n, chosen = F.col(f"_n_{c}"), F.lit(everything)
        for j, margin in reversed(list(enumerate(MARGINS))):
            # one rank for the neighbour of the target and one for rounding, besides the error
            enough = F.lit(wider < float("inf")) & (n * (margin - 1) >= 2 * accuracy)
            chosen = F.when(enough, F.col(f"_ends_{c}")[start + 2 * j]).otherwise(chosen)
        return chosen

    parts, seen = [], dict.fromkeys(columns, 0)
    for i, (c, p) in enumerate(targets):
        rank = F.lit(float(p)) * (F.col(f"_n_{c}") - 1)
        parts += [
            bracket(c, seen[c], float("-inf")).alias(f"_low_{i}"),
            bracket(c, seen[c] + 1, float("inf")).alias(f"_high_{i}"),
            F.when(F.col(f"_n_{c}") > 0, rank).alias(f"_rank_{i}"),
        ]
        seen[c] += 2 * len(MARGINS)
    most = F.greatest(*(F.col(f"_n_{c}") for c in columns), F.lit(0).cast("bigint"))
    share = min(4.0 * wider / accuracy, 1.0)
    return found.select(*by, (most * share).alias("_expected"), *parts)


def _with_brackets(df: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return df.join(brackets, by)
    return df.withColumns({k: F.lit(v).cast(brackets.schema[k].dataType) for k, v in brackets.first().asDict().items()})


def _narrowed(bracketed: DataFrame, targets: Sequence[tuple[str, float]], by: list[str], accuracy: int) -> DataFrame:
    """Brackets cut down by a second sketch, of the values inside them only."""
    aggregates = [(F.max("_expected") * 4.0 / GRID).alias("_expected")]
    for i, (c, _) in enumerate(targets):
        x, low, high = F.col(c).cast("double"), F.col(f"_low_{i}"), F.col(f"_high_{i}")
        inside = x.between(low, high)
        steps = [j / GRID for j in range(GRID + 1)]
        aggregates += [
            *(F.max(f"_{part}_{i}").alias(f"_{part}_{i}") for part in ("low", "high", "rank")),
            F.count_if(x < low).alias(f"_below_{i}"),
            F.count_if(inside).alias(f"_m_{i}"),
            F.percentile_approx(F.when(inside, x), steps, accuracy).alias(f"_grid_{i}"),
        ]
    found = bracketed.groupBy(*by).agg(*aggregates)
    parts = []
    for i in range(len(targets)):
        m, grid = F.col(f"_m_{i}"), F.col(f"_grid_{i}")
        place = F.try_divide(F.col(f"_rank_{i}") - F.col(f"_below_{i}"), m)
        margin = 2.0 / accuracy + F.try_divide(F.lit(2.0), m)
        first = F.greatest(F.floor((place - margin) * GRID), F.lit(0)).cast("int")
        last = F.least(F.ceil((place + margin) * GRID), F.lit(GRID)).cast("int")
        parts += [
            F.coalesce(F.when(first > 0, F.get(grid, first)), f"_low_{i}").alias(f"_low_{i}"),
            F.coalesce(F.when(last < GRID, F.get(grid, last)), f"_high_{i}").alias(f"_high_{i}"),
            F.col(f"_rank_{i}"),
        ]
    return found.select(*by, "_expected", *parts)


def _between(low: Column, high: Column, rank: Column) -> Column:
    """Linear interpolation, measured from the nearer neighbour as array libraries do."""
    share, gap = rank - F.floor(rank), high - low
    return F.when(share < 0.5, low + gap * share).otherwise(high - gap * (1 - share))


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(all_known(*keys)) if keys else df


def exact_quantiles(
    df: DataFrame,
    targets: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    summary: DataFrame | None = None,
) -> DataFrame:
    """One row per group with one column per target, ``{name: (column, probability)}``.

    Nulls do not take part, rows with a null key are dropped, and groups without any value have
    no row. Ranks are computed when this is called. Should a sketch be worse than promised and a rank lie
    outside its bracket, all brackets are widened and the rows are scanned again. With ``summary``, a table by
    ``summaries.quantile_summary`` over the same rows with at least these keys and columns, the scan for the sketch is saved.
    """
    by, wanted = list(by), list(targets.values())
    if summary is not None:
        summary = summaries.merged(summary, by, list(dict.fromkeys(c for c, _ in wanted)))
    for wider in WIDER:
        found = small_side(_ranks(df, wanted, by, accuracy, wider, summary))
        if found.where("_low is null or _high is null").isEmpty():
            break

    def pick(i: int) -> Column:
        here = F.col("_i") == i
        return F.max(F.when(here, _between(F.col("_low"), F.col("_high"), F.col("_rank"))))

    return found.groupBy(*by).agg(*(pick(i).cast("double").alias(name) for i, name in enumerate(targets)))


def _ranks(
    df: DataFrame,
    wanted: list[tuple[str, float]],
    by: list[str],
    accuracy: int,
    wider: float,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Per group and target number ``_i``: the rank and the values just below and above it, null if missed."""
    if summary is None:
        brackets = small_side(_sketch(df, wanted, by, accuracy, wider))
    else:
        brackets = small_side(summaries.brackets(known_keys(summary, by), wanted, by, wider))
    bracketed = _with_brackets(df, brackets, by)
    while not brackets.where(F.col("_expected") > BRACKET_ROWS).isEmpty():
        brackets = small_side(_narrowed(bracketed, wanted, by, accuracy))
        bracketed = _with_brackets(df, brackets, by)

    def hit(i: int, column: str) -> Column:
        # below the bracket only the number of rows matters, so those rows share one null value
        x = F.col(column).cast("double")
        value = F.when(x >= F.col(f"_low_{i}"), x)
        entry = F.struct(F.lit(i).alias("_i"), F.col(f"_rank_{i}").alias("_rank"), value.alias("_x"))
        return F.when(x <= F.col(f"_high_{i}"), entry)

    hits = F.array_compact(F.array(*(hit(i, c) for i, (c, _) in enumerate(wanted))))
    counts = (
        bracketed.select(*by, F.inline(hits))
        .groupBy(*by, "_i", "_x")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_rank").alias("_rank"))
    )
    # a task per group and target serves both the running count and the pick
    gathered = counts.repartition(*by, "_i")
    running = Window.partitionBy(*by, "_i").orderBy(F.col("_x").asc_nulls_first())
    placed = gathered.withColumn("_to", F.sum("_c").over(running))

    def at(position: Column) -> Column:
        inside = (F.col("_to") - F.col("_c") <= position) & (position < F.col("_to"))
        return F.max(F.when(inside, F.col("_x")))

    return placed.groupBy(*by, "_i").agg(
        at(F.floor("_rank")).alias("_low"), at(F.ceil("_rank")).alias("_high"), F.max("_rank").alias("_rank")
    )


def quantile_values(
    df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int = ACCURACY
) -> list[float | None]:
    """Quantiles of a whole column as plain numbers, nulls when there is no value."""
    targets = {f"q{i}": (column, p) for i, p in enumerate(probabilities)}
    return list(exact_quantiles(df, targets, accuracy=accuracy).first())
