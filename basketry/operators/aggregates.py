"""Grouped and global aggregates shared by the reports."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import elapsed_days, exact_mean, money_mean, money_sum, ratio
from basketry.operators.filters import known
from basketry.operators.quantiles import exact_quantiles


def group(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Grouped aggregate that drops null keys; output columns carry the argument names."""
    named = [column.alias(name) for name, column in aggregates.items()]
    return known(df, *keys).groupBy(*keys).agg(*named)


def distinct_orders() -> Column:
    return F.count_distinct("order_id")


def count_distinct_orders(df: DataFrame, *keys: str) -> DataFrame:
    return group(df, keys, order_count=distinct_orders())


def sum_price(df: DataFrame, *keys: str) -> DataFrame:
    return group(df, keys, total_price=money_sum("price"))


def means(df: DataFrame, *keys: str) -> DataFrame:
    return group(
        df,
        keys,
        mean_freight=money_mean("freight_value"),
        mean_price=money_mean("price"),
        mean_score=exact_mean("review_score"),
        mean_delivery_time=exact_mean("delivery_time", 0),
    )


def medians(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Exact median per group; ``columns`` maps output name to input column."""
    return exact_quantiles(df, {name: (c, 0.5) for name, c in columns.items()}, keys)


def standard_deviations(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Sample standard deviation per group, null for a single value."""
    return group(df, keys, **{name: F.stddev_samp(F.col(c).cast("double")) for name, c in columns.items()})


def count_rows(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows per group in which the column has a value."""
    return group(df, keys, row_count=F.count(column))


def first_and_last_order(df: DataFrame) -> DataFrame:
    ts = "order_purchase_timestamp"
    return group(df, ["customer_unique_id"], first_order=F.min(ts), last_order=F.max(ts))


def customer_orders(df: DataFrame) -> DataFrame:
    """One row per customer: number of orders, first and last purchase."""
    ts = "order_purchase_timestamp"
    return group(
        df,
        ["customer_unique_id"],
        order_count=distinct_orders(),
        first_order=F.min(ts),
        last_order=F.max(ts),
    )


def recurring(customers: DataFrame) -> DataFrame:
    return customers.where(F.col("order_count") > 1)


def share_of_recurring(customers: DataFrame) -> DataFrame:
    """Customers, those with more than one order, and their share."""
    totals = customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("order_count") > 1).alias("recurring_customers"),
    )
    return totals.withColumn("recurring_share", ratio("recurring_customers", "customers"))


def by_state_pair(df: DataFrame) -> DataFrame:
    return group(
        df,
        ["customer_state", "seller_state"],
        mean_freight=money_mean("freight_value"),
        mean_price=money_mean("price"),
    )


def mean_order_total(df: DataFrame, key: str) -> DataFrame:
    """Total per order first, then the mean of those totals per key."""
    orders = group(df, ["order_id", key], order_total=F.sum(F.col("price").cast("decimal(18,2)")))
    return group(
        orders,
        [key],
        mean_order_value=ratio(F.sum("order_total"), F.count("order_total")),
    )


def latest_purchase(df: DataFrame) -> Column:
    """The last purchase of the whole frame, as a scalar subquery."""
    return df.agg(F.max("order_purchase_timestamp")).scalar()


def recency(df: DataFrame) -> DataFrame:
    """Days from each customer's last order to the last order of all."""
    last = group(df, ["customer_unique_id"], last_order=F.max("order_purchase_timestamp"))
    return last.select(
        "customer_unique_id", elapsed_days(latest_purchase(df), "last_order").alias("recency")
    )


def value_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Frequency table of a column within each group, in order of the value."""
    counts = group(df, [*keys, column], row_count=F.count(F.lit(1)))
    return counts.orderBy(*keys, column)


def count_by(df: DataFrame, column: str) -> DataFrame:
    return group(df, [column], row_count=F.count(F.lit(1)))


def top_k(df: DataFrame, measure: str, tie_break: str, k: int = 10) -> DataFrame:
    """First k rows by a measure, largest first; ties are ordered by a unique key."""
    return sort_desc(df, measure, tie_break).limit(k)


def sort_desc(df: DataFrame, measure: str, tie_break: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc(), F.col(tie_break))
