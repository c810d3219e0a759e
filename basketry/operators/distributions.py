"""Histograms, density curves and box statistics as tables."""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.operators.aggregates import group
from basketry.operators.filters import known
from basketry.operators.quantiles import exact_quantiles
from basketry.operators.sampling import bottom_k
from basketry.operators.sizing import small_side
from basketry.session import cut_lineage

# Kernel widths beyond which a kernel is left out of a sum; what it still has there is part of the stated bound.
REACH = 8.5


def collapsed(df: DataFrame, column: str) -> DataFrame:
    """The different values of a column and how many rows have each."""
    values = known(df.select(F.col(column).cast("double").alias("value")), "value")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("weight"))


def distribution(df: DataFrame, column: str, bins: int, points: int = 200) -> tuple[DataFrame, DataFrame]:
    """Histogram and density curve of a column from one pass over its rows."""
    weighted = cut_lineage(collapsed(df, column))
    return weighted_histogram(weighted, bins), weighted_density(weighted, bins, points)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are listed."""
    return weighted_histogram(collapsed(df, column), bins)


def density(df: DataFrame, column: str, bins: int, points: int = 200) -> DataFrame:
    """Gaussian kernel density on a grid from minimum to maximum, scaled to counts per bin."""
    return weighted_density(collapsed(df, column), bins, points)


def weighted_histogram(weighted: DataFrame, bins: int) -> DataFrame:
    """A constant column gets the range of one unit around its value."""
    extent = weighted.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    flat = extent["low"] == extent["high"]
    low = F.when(flat, extent["low"] - 0.5).otherwise(extent["low"])
    high = F.when(flat, extent["high"] + 0.5).otherwise(extent["high"])
    # multiplied before it is divided: a rounded bin width would move values between bins
    bin_of = F.least(F.floor((F.col("value") - low) * bins / (high - low)), F.lit(bins - 1))
    counted = weighted.groupBy(bin_of.cast("int").alias("bin")).agg(F.sum("weight").alias("row_count"))
    every = weighted.sparkSession.range(bins, numPartitions=1).select(F.col("id").cast("int").alias("bin"))

    def edge(i: Column) -> Column:
        return low + i * (high - low) / bins

    # at most one counted row per bin, so that side is safe to broadcast
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
    )


def _shape(weighted: DataFrame) -> Column:
    """Rows, extent and kernel width (Scott's rule) of a column with weights.

    Deviations are taken from the mean in a second pass: sums of squares would lose digits.
    """
    rows = weighted.agg(
        F.struct(
            F.sum("weight").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("mean"),
        ).alias("s")
    ).scalar()
    gap = F.col("value") - rows["mean"]
    variance = F.try_divide(F.sum(F.col("weight") * gap * gap), F.sum("weight") - 1)
    scott = F.pow(F.sum("weight").cast("double"), F.lit(-0.2))
    return weighted.agg(
        F.struct(
            F.sum("weight").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            (F.sqrt(variance) * scott).alias("width"),
        )
    ).scalar()


def weighted_density(weighted: DataFrame, bins: int, points: int = 200) -> DataFrame:
    """Every value adds its kernel to the grid; the sums of a task are combined before the exchange."""
    s = _shape(weighted)

    def at(point: Column) -> Column:
        return s["low"] + point * (s["high"] - s["low"]) / (points - 1)

    spread = weighted.where(s["width"] > 0).select(
        "value", "weight", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    z = (at(F.col("point")) - F.col("value")) / s["width"]
    sums = spread.groupBy("point").agg(F.sum(F.col("weight") * F.exp(-0.5 * z * z)).alias("_k"))
    # count of rows times bin width, over n times the kernel's own norm
    bin_width = (s["high"] - s["low"]) / bins
    norm = s["width"] * math.sqrt(2 * math.pi)
    return sums.select(
        "point", at(F.col("point")).alias("position"), (F.col("_k") * bin_width / norm).alias("density")
    )


def binned_density(
    df: DataFrame, column: str, bins: int, points: int = 200, tolerance: float = 1e-5
) -> DataFrame:
    """The density curve of a continuous column from a fine grid instead of its single values, with its error bound.

    Every row is shared by the two grid positions around it, the nearer one getting more. That replaces its
    kernel by a chord between them, which is off by at most step² / 8 times the largest second derivative, 1 /
    width². The step is the width times sqrt(8 * ``tolerance``), so a row adds at most ``tolerance`` times the
    height of its kernel to the error; ``bound`` is the sum of that over all rows. After the first aggregate there are
    at most range / step + 2 rows, and each meets only the points within REACH widths. A column with
    one value or none has no curve.
    """
    if not tolerance > 0:
        raise ValueError("tolerance must be positive")
    values = known(df.select(F.col(column).cast("double").alias("value")), "value")
    s = _shape(values.withColumn("weight", F.lit(1)))
    step, gap = s["width"] * math.sqrt(8 * tolerance), (s["high"] - s["low"]) / (points - 1)
    place = (F.col("value") - s["low"]) / step
    cell, share = F.floor(place), place - F.floor(place)
    shares = F.array(
        F.struct(cell.alias("cell"), (1 - share).alias("share")), F.struct((cell + 1).alias("cell"), share.alias("share"))
    )
    cells = values.where(s["width"] > 0).select(F.inline(shares)).groupBy("cell").agg(F.sum("share").alias("weight"))

    def point_at(position: Column) -> Column:
        return (position - s["low"]) / gap

    at, reach = s["low"] + F.col("cell") * step, REACH * s["width"]
    first = F.greatest(F.ceil(point_at(at - reach)), F.lit(0)).cast("int")
    last = F.least(F.floor(point_at(at + reach)), F.lit(points - 1)).cast("int")
    near = cells.select("weight", at.alias("at"), first.alias("first"), last.alias("last")).where("first <= last")
    spread = near.select("weight", "at", F.explode(F.sequence("first", "last")).alias("point"))
    z = (s["low"] + F.col("point") * gap - F.col("at")) / s["width"]
    sums = spread.groupBy("point").agg(F.sum(F.col("weight") * F.exp(-0.5 * z * z)).alias("_k"))
    every = df.sparkSession.range(points, numPartitions=1).select(F.col("id").cast("int").alias("point"))
    height = (s["high"] - s["low"]) / bins / (s["width"] * math.sqrt(2 * math.pi))
    # at most one sum per point, so that side is safe to broadcast
    return every.where(s["width"] > 0).join(F.broadcast(sums), "point", "left").select(
        "point",
        (s["low"] + F.col("point") * gap).alias("position"),
        (F.coalesce("_k", F.lit(0.0)) * height).alias("density"),
        (s["n"] * (tolerance + math.exp(-0.5 * REACH**2)) * height).alias("bound"),
    )


def _with_fences(df: DataFrame, values: Sequence[str], by: str) -> DataFrame:
    """Rows with the quartiles ``<value>_q1`` … ``_q3`` of their group and the ends of its fences."""
    targets = {f"{v}_q{i}": (v, 0.25 * i) for v in values for i in (1, 2, 3)}
    quartiles = small_side(exact_quantiles(df, targets, [by]))
    joined = known(df, by).join(quartiles, by, "left")
    for v in values:
        q1, q3 = F.col(f"{v}_q1"), F.col(f"{v}_q3")
        reach = 1.5 * (q3 - q1)
        joined = joined.withColumns({f"{v}_low": q1 - reach, f"{v}_high": q3 + reach})
    return joined


def _inside(value: str) -> Column:
    return F.col(value).cast("double").between(F.col(f"{value}_low"), F.col(f"{value}_high"))


def box_summaries(
    df: DataFrame, values: Sequence[str], by: str, **more: Column
) -> DataFrame:
    """Box statistics of several columns per group in one pass, and further aggregates beside them."""
    parts: dict[str, Column] = {}
    for v in values:
        x, inside = F.col(v).cast("double"), _inside(v)
        parts |= {f"{v}_q{i}": F.max(f"{v}_q{i}") for i in (1, 2, 3)}
        parts |= {
            f"{v}_whisker_low": F.least(F.min(F.when(inside, x)), F.max(f"{v}_q1")),
            f"{v}_whisker_high": F.greatest(F.max(F.when(inside, x)), F.max(f"{v}_q3")),
            f"{v}_outliers": F.count_if(~inside),
            f"{v}_rows": F.count(v),
        }
    return group(_with_fences(df, values, by), [by], **parts, **more)


def one_box(summaries: DataFrame, value: str, by: str) -> DataFrame:
    """The box statistics of one column, groups without a value left out."""
    names = {
        "q1": "q1",
        "median": "q2",
        "q3": "q3",
        "whisker_low": "whisker_low",
        "whisker_high": "whisker_high",
        "outliers": "outliers",
        "row_count": "rows",
    }
    return summaries.where(F.col(f"{value}_rows") > 0).select(
        by, *(F.col(f"{value}_{part}").alias(name) for name, part in names.items())
    )


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group.

    Whiskers end at the farthest values within 1.5 interquartile ranges of the box.
    """
    return one_box(box_summaries(df, [value], by), value, by)


def box_outliers(df: DataFrame, value: str, by: str) -> DataFrame:
    """The single values outside the whiskers of their group."""
    fenced = _with_fences(df, [value], by)
    return fenced.where(~_inside(value)).select(by, F.col(value).cast("double").alias(value))


def scatter(
    df: DataFrame,
    x: str,
    y: str,
    extra: Mapping[str, Column] | None = None,
    sample: int | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Point table of two measures; with ``sample`` at most that many points, drawn by the hash of the columns ``key``."""
    points = df.select(
        F.col(x).alias("x"),
        F.col(y).alias("y"),
        *(c.alias(k) for k, c in (extra or {}).items()),
        *(F.col(k).alias(f"_key_{i}") for i, k in enumerate(key) if sample is not None),
    )
    if sample is None:
        return points
    if not key:
        raise ValueError("a sample needs the columns that tell points apart")
    names = [f"_key_{i}" for i in range(len(key))]
    return bottom_k(points, names, sample).drop(*names)
