"""Running totals and ranks over a whole column, without gathering it in one task.

A column is cut at approximate quantiles into buckets of similar size. The totals of the buckets
are few, so the offset of each bucket comes from a window over them; the rest is a window inside
each bucket.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 16_384
ROWS_PER_BUCKET = 20_000


def cut_points(df: DataFrame, column: str, buckets: int = BUCKETS) -> list[float]:
    """Approximate quantiles that cut the rows into buckets of similar size."""
    shares = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(column, shares, 0.25 / buckets)
    return sorted(set(found))


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], name: str = "_bucket") -> DataFrame:
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="error")
    return bucketizer.transform(df).withColumn(name, F.col(name).cast("int"))


def with_running_totals(
    df: DataFrame,
    column: str,
    sums: Sequence[str],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<name>_to``, the running total up to and including each row, for every sum column.

    ``column`` must be unique per row. The frame is read more than once, so hand in a checkpointed
    or written one if it is costly.
    """
    if buckets is None:
        buckets = max(1, min(BUCKETS, df.count() // ROWS_PER_BUCKET))
    cuts = cut_points(df, column, buckets) if buckets > 1 else []
    rows = with_bucket(df.withColumn(column, F.col(column).cast("double")), column, cuts)

    def key(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    totals = rows.groupBy("_bucket").agg(*(F.sum(s).alias(s) for s in sums))
    before = Window.orderBy(key("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, at most BUCKETS + 1
    offsets = F.broadcast(
        totals.select("_bucket", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums))
    )
    inside = (
        Window.partitionBy("_bucket")
        .orderBy(key(column))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = rows.join(offsets, "_bucket")
    running = {f"{s}_to": F.sum(s).over(inside) + F.col(f"_off_{s}") for s in sums}
    return placed.withColumns(running).drop(*(f"_off_{s}" for s in sums))
