"""How many customers come back, and after how long."""

from __future__ import annotations

from pyspark.sql import DataFrame

from basketry.functions import elapsed_days, format_percent
from basketry.operators.aggregates import customer_orders, recurring, share_of_recurring
from basketry.operators.distributions import distribution
from basketry.session import cut_lineage


def _retention(customers: DataFrame) -> DataFrame:
    shares = share_of_recurring(customers)
    return shares.withColumn("recurring_percent", format_percent("recurring_share"))


def _days(customers: DataFrame) -> DataFrame:
    days = elapsed_days("last_order", "first_order")
    return recurring(customers).withColumn("days_between_orders", days)


def customer_retention(fact: DataFrame) -> DataFrame:
    return _retention(customer_orders(fact))


def days_first_to_last_order(fact: DataFrame) -> DataFrame:
    return _days(customer_orders(fact))


def orders_per_customer_distribution(fact: DataFrame, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Histogram and density of the number of orders per customer."""
    return distribution(customer_orders(fact), "order_count", bins)


def days_between_distribution(fact: DataFrame, bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """Histogram and density of the days between first and last order of recurring customers."""
    return distribution(days_first_to_last_order(fact), "days_between_orders", bins)


def retention_reports(fact: DataFrame) -> dict[str, DataFrame]:
    """All reports on retention; the customer frame is computed once."""
    customers = cut_lineage(customer_orders(fact))
    orders = distribution(customers, "order_count", 20)
    days = distribution(_days(customers), "days_between_orders", 30)
    return {
        "customer_retention": _retention(customers),
        "orders_per_customer_histogram": orders[0],
        "orders_per_customer_density": orders[1],
        "days_between_histogram": days[0],
        "days_between_density": days[1],
    }
