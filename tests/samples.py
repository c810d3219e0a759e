"""Small hand-made tables with known answers."""

from datetime import datetime

from basketry.operators.joins import SalesTables
from basketry.sources.schemas import CATALOG


def when(text):
    return datetime.fromisoformat(text) if text else None


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ddl(table, *names):
    types = next(spec.types for spec in CATALOG if spec.name == table)
    return ", ".join(f"{n} {types[n]}" for n in names)


def sales_tables(spark, orders, items, reviews=(), products=None, sellers=None, customers=None):
    """Orders: (id, customer, bought, delivered, estimated); items: (order, product, seller, price, freight)."""
    products = products or sorted({(i[1], f"category-{i[1]}") for i in items})
    sellers = sellers or sorted({(i[2], "SP") for i in items})
    customers = customers or sorted({(o[1], o[1], "SP") for o in orders})
    return SalesTables(
        frame(
            spark,
            [(o[0], o[1], "delivered", when(o[2]), when(o[3]), when(o[4])) for o in orders],
            ddl(
                "orders",
                "order_id",
                "customer_id",
                "order_status",
                "order_purchase_timestamp",
                "order_delivered_customer_date",
                "order_estimated_delivery_date",
            ),
        ),
        frame(spark, items, ddl("order_items", "order_id", "product_id", "seller_id", "price", "freight_value")),
        frame(spark, products, ddl("products", "product_id", "product_category_name")),
        frame(spark, customers, ddl("customers", "customer_id", "customer_unique_id", "customer_state")),
        frame(spark, sellers, ddl("sellers", "seller_id", "seller_state")),
        frame(
            spark,
            [(f"r{i}", o, s, when("2020-01-01")) for i, (o, s) in enumerate(reviews)],
            ddl("order_reviews", "review_id", "order_id", "review_score", "review_answer_timestamp"),
        ),
    )
