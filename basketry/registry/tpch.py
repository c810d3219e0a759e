"""The given test tables in the roles of the sales tables.

``ORACLE_ROLES`` states the same roles as SQL for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.functions import add_seconds
from basketry.operators.joins import SalesTables
from basketry.sources.schemas import CATALOG
from basketry.sources.sinks import write_report


def _days(n: int) -> Column:
    return F.expr(f"interval '{n}' day")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_tables(spark: SparkSession, sf_dir: str) -> SalesTables:
    raw_orders = read(spark, sf_dir, "orders")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = F.col

    bought = add_seconds("o_orderdate", (c("o_orderkey") * 7919) % 86400)
    orders = raw_orders.select(
        c("o_orderkey").alias("order_id"),
        c("o_custkey").alias("customer_id"),
        c("o_orderstatus").alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        add_seconds(bought, (c("o_orderkey") * 31) % 7200).alias("order_approved_at"),
        (c("o_orderdate") + _days(3)).alias("order_delivered_carrier_date"),
        (c("o_orderdate") + _days(30)).alias("order_estimated_delivery_date"),
    )
    items = read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("order_id"),
        c("l_linenumber").alias("order_item_id"),
        c("l_partkey").alias("product_id"),
        c("l_suppkey").alias("seller_id"),
        (c("l_shipdate") + _days(7)).alias("shipping_limit_date"),
        c("l_extendedprice").alias("price"),
        (c("l_extendedprice") * c("l_tax")).alias("freight_value"),
        add_seconds("l_shipdate", (c("l_partkey") * 104729) % 86400).alias("shipped_item_at"),
    )
    products = read(spark, sf_dir, "part").select(
        c("p_partkey").alias("product_id"),
        F.when(c("p_type") != "ECONOMY", c("p_type")).alias("product_category_name"),
        F.length("p_name").alias("product_name_length"),
        F.length("p_type").alias("product_description_lenght"),
        (c("p_size") % 5).alias("product_photos_qty"),
        c("p_size").cast("double").alias("product_weight_g"),
        (c("p_size") % 7 + 1).cast("double").alias("product_length_cm"),
        (c("p_size") % 11 + 1).cast("double").alias("product_height_cm"),
        (c("p_size") % 13 + 1).cast("double").alias("product_width_cm"),
    )
    customers = (
        read(spark, sf_dir, "customer")
        .join(nation, c("c_nationkey") == c("n_nationkey"))
        .select(
            c("c_custkey").alias("customer_id"),
            c("c_custkey").alias("customer_unique_id"),
            F.lpad(c("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
            c("c_mktsegment").alias("customer_city"),
            c("n_name").alias("customer_state"),
        )
    )
    sellers = (
        read(spark, sf_dir, "supplier")
        .join(nation, c("s_nationkey") == c("n_nationkey"))
        .select(
            c("s_suppkey").alias("seller_id"),
            F.lpad(c("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
            c("s_name").alias("seller_city"),
            c("n_name").alias("seller_state"),
        )
    )

    def review(copy: int, score: Column) -> list[Column]:
        return [
            (c("o_orderkey") * 2 + copy).alias("review_id"),
            c("o_orderkey").alias("order_id"),
            score.cast("int").alias("review_score"),
            c("o_orderpriority").alias("review_comment_title"),
            c("o_orderstatus").alias("review_comment_message"),
            (c("o_orderdate") + _days(40 + copy)).alias("review_creation_date"),
            (c("o_orderdate") + _days(42 + copy)).alias("review_answer_timestamp"),
        ]

    rated = raw_orders.where(c("o_orderpriority") != "4-NOT SPECIFIED")
    reviews = rated.select(review(0, F.substring("o_orderpriority", 1, 1))).unionByName(
        raw_orders.where(c("o_orderkey") % 50 == 0).select(review(1, F.lit(5)))
    )

    def payment(sequence: int, kind: str, parts: Column, value: Column) -> list[Column]:
        return [
            c("o_orderkey").alias("order_id"),
            F.lit(sequence).alias("payment_sequential"),
            F.lit(kind).alias("payment_type"),
            parts.cast("int").alias("payment_installments"),
            value.alias("payment_value"),
        ]

    payments = raw_orders.select(
        payment(1, "card", 1 + c("o_orderkey") % 10, c("o_totalprice"))
    ).unionByName(
        raw_orders.where(c("o_orderkey") % 40 == 0).select(
            payment(2, "voucher", F.lit(1), c("o_totalprice") / 2)
        )
    )
    delivered = F.when(c("order_status") != "P", c("shipped_item_at"))
    return SalesTables(
        orders,
        items,
        products,
        customers,
        sellers,
        reviews,
        payments,
        derived={"order_delivered_customer_date": delivered},
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation → region in the role of the state → region lookup."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("state"), F.col("r_name").alias("region")
    )


def write_csv_catalog(spark: SparkSession, sf_dir: str, base_path: str) -> str:
    """All nine catalogue tables as CSV, with the file names, headers and free text of a real export."""
    tables = sales_tables(spark, sf_dir).as_views()
    message = F.concat(F.lit('said "'), "review_comment_message", F.lit('",\ntwice'))
    tables["order_reviews"] = tables["order_reviews"].withColumn("review_comment_message", message)
    tables["geolocation"] = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("geolocation_zip_code_prefix"), F.col("n_name").alias("geolocation_state")
    )
    kind = read(spark, sf_dir, "part").select(F.col("p_type").alias("product_category_name")).distinct()
    tables["category_translation"] = kind.withColumn("product_category_name_english", F.lower("product_category_name"))
    for spec in CATALOG:
        back = {new: old for old, new in spec.renames.items()}
        write_report(tables[spec.name].withColumnsRenamed(back), f"{base_path}/{spec.file.replace('*', 'shop_')}", "csv")
    return base_path


ORACLE_ROLES = """
WITH role_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS order_purchase_timestamp,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400 + (o_orderkey * 31) % 7200) AS order_approved_at,
         o_orderdate + INTERVAL 3 DAY AS order_delivered_carrier_date,
         o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date
  FROM orders
), role_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
         l_shipdate + INTERVAL 7 DAY AS shipping_limit_date,
         l_extendedprice AS price, l_extendedprice * l_tax AS freight_value,
         l_shipdate + to_seconds((l_partkey * 104729) % 86400) AS shipped_item_at
  FROM lineitem
), role_products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_type <> 'ECONOMY' THEN p_type END AS product_category_name,
         CAST(length(p_name) AS INTEGER) AS product_name_length,
         CAST(length(p_type) AS INTEGER) AS product_description_lenght,
         p_size % 5 AS product_photos_qty, CAST(p_size AS DOUBLE) AS product_weight_g,
         CAST(p_size % 7 + 1 AS DOUBLE) AS product_length_cm,
         CAST(p_size % 11 + 1 AS DOUBLE) AS product_height_cm,
         CAST(p_size % 13 + 1 AS DOUBLE) AS product_width_cm
  FROM part
), role_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
         lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS customer_zip_code_prefix,
         c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), role_sellers AS (
  SELECT s_suppkey AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS seller_zip_code_prefix,
         s_name AS seller_city, n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), role_reviews AS (
  SELECT o_orderkey * 2 AS review_id, o_orderkey AS order_id,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS review_score,
         o_orderpriority AS review_comment_title, o_orderstatus AS review_comment_message,
         o_orderdate + INTERVAL 40 DAY AS review_creation_date,
         o_orderdate + INTERVAL 42 DAY AS review_answer_timestamp
  FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderkey, 5, o_orderpriority, o_orderstatus,
         o_orderdate + INTERVAL 41 DAY, o_orderdate + INTERVAL 43 DAY
  FROM orders WHERE o_orderkey % 50 = 0
), role_payments AS (
  SELECT o_orderkey AS order_id, 1 AS payment_sequential, 'card' AS payment_type,
         CAST(1 + o_orderkey % 10 AS INTEGER) AS payment_installments, o_totalprice AS payment_value
  FROM orders
  UNION ALL
  SELECT o_orderkey, 2, 'voucher', 1, o_totalprice / 2 FROM orders WHERE o_orderkey % 40 = 0
), role_regions AS (
  SELECT n_name AS state, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
), prepared AS (
  SELECT order_id, customer_id, order_status, order_purchase_timestamp,
         CASE WHEN order_status <> 'P' THEN shipped_item_at END AS order_delivered_customer_date,
         order_estimated_delivery_date, price, freight_value, seller_id, product_category_name,
         customer_unique_id, customer_state, seller_state, CAST(review_score AS DOUBLE) AS review_score,
         product_weight_g
  FROM role_orders JOIN role_items USING (order_id) JOIN role_products USING (product_id)
  JOIN role_customers USING (customer_id) JOIN role_sellers USING (seller_id)
  LEFT JOIN role_reviews USING (order_id)
), cleaned AS (
  SELECT * FROM prepared
  WHERE order_purchase_timestamp IS NOT NULL AND order_delivered_customer_date IS NOT NULL
    AND price > 0 AND freight_value >= 0
), fact AS (
  SELECT * REPLACE (coalesce(review_score, (SELECT median(review_score) FROM cleaned)) AS review_score),
         CAST(floor(date_diff('second', order_purchase_timestamp, order_delivered_customer_date) / 86400.0) AS BIGINT)
           AS delivery_time,
         coalesce(CAST(order_delivered_customer_date > order_estimated_delivery_date AS INTEGER), 0) AS is_late,
         strftime(order_purchase_timestamp, '%Y-%m') AS order_month,
         CAST(isodow(order_purchase_timestamp) AS INTEGER) AS day_of_week_int
  FROM cleaned
)
"""
