"""Equi-joins between the sales tables and small lookups."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from basketry.operators.sizing import dimension

# Columns of the wide view and of the fact, in their published order.
MERGED_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date", "order_item_id", "product_id", "seller_id",
    "shipping_limit_date", "price", "freight_value", "payment_sequential", "payment_type",
    "payment_installments", "payment_value", "review_id", "review_score",
    "review_comment_title", "review_comment_message", "review_creation_date",
    "review_answer_timestamp", "product_category_name", "product_name_length",
    "product_description_lenght", "product_photos_qty", "product_weight_g",
    "product_length_cm", "product_height_cm", "product_width_cm", "customer_unique_id",
    "customer_zip_code_prefix", "customer_city", "customer_state", "seller_zip_code_prefix",
    "seller_city", "seller_state",
)
PREPARED_COLUMNS = (
    "order_id", "customer_id", "order_status", "order_purchase_timestamp",
    "order_delivered_customer_date", "order_estimated_delivery_date", "price", "freight_value",
    "seller_id", "product_category_name", "customer_unique_id", "customer_state",
    "seller_state", "review_score",
)


@dataclass(frozen=True)
class SalesTables:
    """The joined tables; ``derived`` holds columns that need more than one of them."""

    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    customers: DataFrame
    sellers: DataFrame
    order_reviews: DataFrame
    payments: DataFrame | None = None
    derived: Mapping[str, Column] = field(default_factory=dict)

    @classmethod
    def from_catalog(cls, tables: Mapping[str, DataFrame]) -> SalesTables:
        names = ("orders", "order_items", "products", "customers", "sellers", "order_reviews")
        return cls(*(tables[n] for n in names), payments=tables.get("payments"))

    def as_views(self) -> dict[str, DataFrame]:
        views = {
            "orders": self.orders,
            "order_items": self.order_items,
            "products": self.products,
            "customers": self.customers,
            "sellers": self.sellers,
            "order_reviews": self.order_reviews,
        }
        return views | ({"payments": self.payments} if self.payments is not None else {})


def with_dimensions(tables: SalesTables, columns: Collection[str]) -> SalesTables:
    """The same tables; products, sellers and customers have only their keys and ``columns``, and are broadcast if small.

    Items then move once, by their order, instead of by product, seller and order.
    """

    def slim(df: DataFrame, key: str) -> DataFrame:
        return dimension(df.select(*(c for c in df.columns if c == key or c in columns)))

    return replace(
        tables,
        products=slim(tables.products, "product_id"),
        sellers=slim(tables.sellers, "seller_id"),
        customers=slim(tables.customers, "customer_id"),
    )


def order_lines(tables: SalesTables) -> DataFrame:
    return tables.order_items.join(tables.sellers, "seller_id").join(tables.products, "product_id")


def order_heads(tables: SalesTables) -> DataFrame:
    # joined at order grain, so that only orders and not their items move by customer
    return tables.orders.join(tables.customers, "customer_id")


def left_join_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Keep rows without a review; an order with several reviews repeats its rows."""
    return rows.join(reviews, "order_id", "left")


def latest_review(reviews: DataFrame) -> DataFrame:
    """One review per order: the one answered last."""
    rank = F.struct("review_answer_timestamp", "review_id")
    return reviews.groupBy("order_id").agg(
        F.max_by("review_score", rank).alias("review_score"),
    )


def merged_view(tables: SalesTables) -> DataFrame:
    """The wide view: every item of an order with every payment and every review of it."""
    rows = (
        order_heads(tables)
        .join(tables.order_reviews, "order_id")
        .join(tables.payments, "order_id")
        .join(order_lines(tables), "order_id")
    )
    return rows.withColumns(dict(tables.derived)).select(*MERGED_COLUMNS)


def prepared_join(
    tables: SalesTables, dedupe_reviews: bool = False, extra: Sequence[str] = ()
) -> DataFrame:
    """Items with their order, product, customer and seller, and the review if there is one."""
    reviews = latest_review(tables.order_reviews) if dedupe_reviews else tables.order_reviews
    tables = with_dimensions(tables, {*PREPARED_COLUMNS, *extra})
    rows = left_join_reviews(order_heads(tables), reviews.select("order_id", "review_score")).join(
        order_lines(tables), "order_id"
    )
    score = {"review_score": F.col("review_score").cast("double")}
    return rows.withColumns(dict(tables.derived) | score).select(*PREPARED_COLUMNS, *extra)


def region_lookup(states_of_region: Mapping[str, Sequence[str]]) -> Column:
    """A state → region map literal; built from a declared list, so its size is fixed."""
    pairs = [(state, region) for region, states in states_of_region.items() for state in states]
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def with_region(df: DataFrame, regions: Column | DataFrame, state: str = "customer_state") -> DataFrame:
    """Label each state with its region, null when unknown.

    ``regions`` is a map literal or a frame with the columns ``state`` and ``region``.
    """
    if isinstance(regions, Column):
        return df.withColumn("region", regions[F.col(state)])
    return df.join(regions.select(F.col("state").alias(state), "region"), state, "left")
