"""Volume, delivery time, freight, categories and states."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketry.operators import aggregates as agg
from basketry.operators.distributions import box_stats, distribution, scatter
from basketry.operators.filters import same_state
from basketry.session import cut_lineage


def monthly_orders(fact: DataFrame) -> DataFrame:
    return agg.count_distinct_orders(fact, "order_month").orderBy("order_month")


def delivery_time_distribution(fact: DataFrame, bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """Histogram and density of the delivery time of item rows."""
    return distribution(fact, "delivery_time", bins)


def freight_by_state_pair(fact: DataFrame) -> DataFrame:
    return agg.by_state_pair(fact).withColumn("is_same_state", same_state())


def freight_same_state_box(fact: DataFrame) -> DataFrame:
    """Box statistics over the means of state pairs, not over the item rows."""
    return freight_reports(fact)["freight_same_state_box"]


def freight_vs_price_points(fact: DataFrame) -> DataFrame:
    return scatter(freight_by_state_pair(fact), "mean_price", "mean_freight")


def freight_reports(fact: DataFrame) -> dict[str, DataFrame]:
    """All reports on freight from one pass over the fact."""
    pairs = cut_lineage(freight_by_state_pair(fact))
    return {
        "freight_by_state_pair": pairs,
        "freight_same_state_box": box_stats(pairs, "mean_freight", "is_same_state"),
        "freight_vs_price_points": scatter(pairs, "mean_price", "mean_freight"),
    }


def top_categories_revenue(fact: DataFrame, k: int = 10) -> DataFrame:
    totals = agg.sum_price(fact, "product_category_name")
    return agg.top_k(totals, "total_price", "product_category_name", k)


def top_states_avg_order_value(fact: DataFrame, k: int = 10) -> DataFrame:
    values = agg.mean_order_total(fact, "customer_state")
    return agg.top_k(values, "mean_order_value", "customer_state", k)
