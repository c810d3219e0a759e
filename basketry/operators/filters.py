"""Row filters, null handling and outlier removal."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import all_known
from basketry.operators.quantiles import quantile_values


def drop_missing_dates(df: DataFrame) -> DataFrame:
    return known(df, "order_purchase_timestamp", "order_delivered_customer_date")


def price_positive(df: DataFrame) -> DataFrame:
    return df.where((F.col("price") > 0) & ~F.isnan("price"))


def freight_not_negative(df: DataFrame) -> DataFrame:
    return df.where((F.col("freight_value") >= 0) & ~F.isnan("freight_value"))


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns the frame has."""
    return [c for c in wanted if c in df.columns]


def drop_missing_features(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    present = available(df, wanted)
    return known(df, *present)


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows with a null key, which grouping would otherwise keep as a group of its own."""
    return df.where(all_known(*keys)) if keys else df


def _one_median(df: DataFrame, column: str) -> DataFrame:
    counts = known(df.select(column), column).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile(column, F.lit(0.5), F.col("n")).alias("median"))


def small_domain_median(df: DataFrame, column: str, now: bool = False) -> Column:
    """Exact median of a column with few different values.

    A scalar subquery, or a literal when asked for now, so that later queries do not scan again.

    The rows are counted per value first, so the last step sees one row per value.
    """
    median = _one_median(df, column)
    return F.lit(median.first()["median"]).cast("double") if now else median.scalar()


def fill_missing(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), value))


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """Replace nulls by the median of the column, which may have any number of different values."""
    median = quantile_values(df, column, [0.5])[0]
    return fill_missing(df, column, F.lit(median).cast("double"))


def same_state(customer: str = "customer_state", seller: str = "seller_state") -> Column:
    return F.col(customer) == F.col(seller)


def iqr_fences(df: DataFrame, column: str, reach: float = 1.5) -> tuple[float, float] | None:
    q1, q3 = quantile_values(df, column, [0.25, 0.75])
    if q1 is None:
        return None
    return q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)


def filter_iqr(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Keep rows between the outlier fences of a column, both included.

    The fences are two numbers, computed now; as literals they can reach the scan.
    """
    fences = iqr_fences(df, column, reach)
    return df.where(F.col(column).between(*fences)) if fences else df.limit(0)


def filter_iqr_in_turn(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Remove outliers column by column; later fences only see the rows that survived."""
    for column in columns:
        df = filter_iqr(df, column, reach)
    return df
