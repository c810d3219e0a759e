"""The result sets of the sales dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import (
    abbreviate_id,
    exact_mean,
    format_currency,
    format_fixed,
    money_mean,
    money_sum,
)
from basketry.operators import aggregates as agg
from basketry.operators.joins import region_lookup, with_region
from basketry.session import cut_lineage
from basketry.sources.schemas import STATES_OF_REGION

KEYS = ("customer_state", "order_month", "product_category_name", "seller_id")
# Items whose orders are told apart in one task, about 100 MB as pairs of order and key.
ITEMS_PER_TASK = 500_000


def state_sales(fact: DataFrame, regions: Column | DataFrame | None = None) -> DataFrame:
    states = agg.group(
        fact,
        ["customer_state"],
        order_count=agg.distinct_orders(),
        total_price=money_sum("price"),
        mean_freight=money_mean("freight_value"),
        mean_score=exact_mean("review_score"),
    )
    return with_region(states, region_lookup(STATES_OF_REGION) if regions is None else regions)


def _table(states: DataFrame) -> DataFrame:
    table = states.withColumns(
        {
            "total_price_text": format_currency("total_price"),
            "mean_freight_text": format_currency("mean_freight"),
            "mean_score_text": format_fixed("mean_score"),
        }
    )
    return agg.sort_desc(table, "total_price", "customer_state")


def _heatmap(states: DataFrame) -> DataFrame:
    return agg.sort_desc(states.select("customer_state", "region", "total_price"), "total_price", "customer_state")


def _months(fact: DataFrame) -> DataFrame:
    return agg.group(
        fact,
        ["order_month"],
        order_count=agg.distinct_orders(),
        total_price=money_sum("price"),
        mean_delivery_time=exact_mean("delivery_time", 0),
    )


def state_sales_table(fact: DataFrame, regions: Column | DataFrame | None = None) -> DataFrame:
    """Sales per state, largest first, with the texts of the printed table."""
    return _table(state_sales(fact, regions))


def sales_heatmap(fact: DataFrame, regions: Column | DataFrame | None = None) -> DataFrame:
    return _heatmap(state_sales(fact, regions))


def top_states_sales(fact: DataFrame, regions: Column | DataFrame | None = None, k: int = 10) -> DataFrame:
    return agg.top_k(state_sales(fact, regions), "total_price", "customer_state", k)


def monthly_sales(fact: DataFrame) -> DataFrame:
    return _months(fact).select("order_month", "order_count", "total_price").orderBy("order_month")


def monthly_delivery_time(fact: DataFrame) -> DataFrame:
    return _months(fact).select("order_month", "mean_delivery_time").orderBy("order_month")


def top_categories(fact: DataFrame, k: int = 10) -> DataFrame:
    totals = agg.group(
        fact,
        ["product_category_name"],
        order_count=agg.distinct_orders(),
        total_price=money_sum("price"),
    )
    return agg.top_k(totals, "total_price", "product_category_name", k)


def top_sellers(fact: DataFrame, k: int = 10) -> DataFrame:
    totals = agg.group(
        fact,
        ["seller_id"],
        order_count=agg.distinct_orders(),
        total_price=money_sum("price"),
        mean_score=exact_mean("review_score"),
    )
    best = agg.top_k(totals, "total_price", "seller_id", k)
    return best.withColumn("seller_label", abbreviate_id("seller_id"))


def dashboard_totals(fact: DataFrame) -> DataFrame:
    """Totals per state, month, category and seller; ``total_of`` names the key of a row.

    Sums go by grouping sets straight from the items, so only groups move. Orders are counted apart: the order and the
    keys of an item move once, by the order, and the different pairs of order and key are found where they land. Rows
    without a value of the key are left out of its totals.
    """
    c = F.col
    items = fact.select(
        *KEYS,
        c("price").cast("decimal(18,2)").alias("price"),
        c("freight_value").cast("decimal(18,4)").alias("freight"),
        c("review_score").cast("decimal(18,4)").alias("score"),
        c("delivery_time").cast("decimal(18,0)").alias("days"),
    )
    sums = items.groupingSets([[key] for key in KEYS], *KEYS).agg(
        F.grouping_id().alias("set_id"),
        *(F.sum(v).alias(v) for v in ("price", "freight", "score", "days")),
        *(F.count(v).alias(n) for v, n in (("freight", "freights"), ("score", "scores"), ("days", "deliveries"))),
    )
    # a bit of the id is set for each key that a row is not grouped by
    every = 2 ** len(KEYS) - 1
    key_of = {every - 2 ** (len(KEYS) - 1 - i): key for i, key in enumerate(KEYS)}
    named = F.create_map(*(F.lit(x) for pair in key_of.items() for x in pair))
    known_key = F.coalesce(*(c(k).cast("string") for k in KEYS))
    sums = sums.withColumns({"total_of": named[c("set_id").cast("int")], "_key": known_key}).where(known_key.isNotNull())
    totals = sums.join(_orders_of(fact), ["total_of", "_key"], "left")

    def mean(total: str, count: str) -> Column:
        return F.try_divide(F.col(total).cast("double"), F.col(count).cast("double"))

    return totals.select(
        "total_of",
        *KEYS,
        F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("total_price"),
        mean("freight", "freights").alias("mean_freight"),
        mean("score", "scores").alias("mean_score"),
        mean("days", "deliveries").alias("mean_delivery_time"),
    )


def _orders_of(fact: DataFrame) -> DataFrame:
    """(total_of, _key, order_count): different orders per value of each key, the value as text."""
    placed = fact.select("order_id", *KEYS).where(F.col("order_id").isNotNull())
    tasks = max(fact.sparkSession.sparkContext.defaultParallelism, -(-fact.count() // ITEMS_PER_TASK))
    keys = F.array(*(F.struct(F.lit(k).alias("total_of"), F.col(k).cast("string").alias("_key")) for k in KEYS))
    pairs = placed.repartition(tasks, "order_id").select("order_id", F.inline(keys)).where(F.col("_key").isNotNull())
    # placed by the order, so equal pairs are in one task and no further exchange is needed
    pairs = pairs.groupBy("order_id", "total_of", "_key").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("total_of", "_key").agg(F.count("_one").alias("order_count"))


def dashboard_reports(fact: DataFrame, regions: Column | DataFrame | None = None, k: int = 10) -> dict[str, DataFrame]:
    """All result sets of the dashboard from one scan of the fact."""
    totals = cut_lineage(dashboard_totals(fact))

    def of(key: str, *measures: str) -> DataFrame:
        return totals.where(F.col("total_of") == key).select(key, "order_count", "total_price", *measures)

    states = with_region(
        of("customer_state", "mean_freight", "mean_score"), region_lookup(STATES_OF_REGION) if regions is None else regions
    )
    months = of("order_month", "mean_delivery_time")
    sellers = agg.top_k(of("seller_id", "mean_score"), "total_price", "seller_id", k)
    return {
        "state_sales_table": _table(states),
        "sales_heatmap": _heatmap(states),
        "top_states_sales": agg.top_k(states, "total_price", "customer_state", k),
        "monthly_sales": months.select("order_month", "order_count", "total_price").orderBy("order_month"),
        "monthly_delivery_time": months.select("order_month", "mean_delivery_time").orderBy("order_month"),
        "top_categories": agg.top_k(of("product_category_name"), "total_price", "product_category_name", k),
        "top_sellers": sellers.withColumn("seller_label", abbreviate_id("seller_id")),
    }
