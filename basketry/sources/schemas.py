"""Declared columns of the source tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping

TEXT, INT, REAL, TIME = "string", "int", "double", "timestamp_ntz"


@dataclass(frozen=True)
class TableSpec:
    """Where a table comes from and which types its columns have.

    ``file`` is a path pattern, so the name of a file may carry any prefix.

    Columns that are not declared are kept as text. ``free_text`` marks tables whose quoted
    fields may hold line breaks: only those give up splitting a file over several tasks.
    """

    name: str
    file: str
    types: Mapping[str, str] = field(default_factory=dict)
    renames: Mapping[str, str] = field(default_factory=dict)
    free_text: bool = False


# File names, table names and column names of the source data set.
CATALOG: tuple[TableSpec, ...] = (
    TableSpec(
        "order_items",
        "*order_items_dataset.csv",
        {
            "order_id": TEXT,
            "order_item_id": INT,
            "product_id": TEXT,
            "seller_id": TEXT,
            "shipping_limit_date": TIME,
            "price": REAL,
            "freight_value": REAL,
        },
    ),
    TableSpec(
        "order_reviews",
        "*order_reviews_dataset.csv",
        {
            "review_id": TEXT,
            "order_id": TEXT,
            "review_score": INT,
            "review_comment_title": TEXT,
            "review_comment_message": TEXT,
            "review_creation_date": TIME,
            "review_answer_timestamp": TIME,
        },
        free_text=True,
    ),
    TableSpec(
        "orders",
        "*orders_dataset.csv",
        {
            "order_id": TEXT,
            "customer_id": TEXT,
            "order_status": TEXT,
            "order_purchase_timestamp": TIME,
            "order_approved_at": TIME,
            "order_delivered_carrier_date": TIME,
            "order_delivered_customer_date": TIME,
            "order_estimated_delivery_date": TIME,
        },
    ),
    TableSpec(
        "products",
        "*products_dataset.csv",
        {
            "product_id": TEXT,
            "product_category_name": TEXT,
            "product_name_length": INT,
            "product_description_lenght": INT,
            "product_photos_qty": INT,
            "product_weight_g": REAL,
            "product_length_cm": REAL,
            "product_height_cm": REAL,
            "product_width_cm": REAL,
        },
        renames={"product_name_lenght": "product_name_length"},
    ),
    TableSpec("geolocation", "*geolocation_dataset.csv"),
    TableSpec(
        "sellers",
        "*sellers_dataset.csv",
        {
            "seller_id": TEXT,
            "seller_zip_code_prefix": TEXT,
            "seller_city": TEXT,
            "seller_state": TEXT,
        },
    ),
    TableSpec(
        "payments",
        "*order_payments_dataset.csv",
        {
            "order_id": TEXT,
            "payment_sequential": INT,
            "payment_type": TEXT,
            "payment_installments": INT,
            "payment_value": REAL,
        },
    ),
    TableSpec(
        "customers",
        "*customers_dataset.csv",
        {
            "customer_id": TEXT,
            "customer_unique_id": TEXT,
            "customer_zip_code_prefix": TEXT,
            "customer_city": TEXT,
            "customer_state": TEXT,
        },
    ),
    TableSpec("category_translation", "*category_name_translation.csv"),
)

# Texts that stand for a missing field when a CSV file is read.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Region of each Brazilian state.
STATES_OF_REGION = {
    "Norte": ("AC", "AM", "AP", "PA", "RO", "RR", "TO"),
    "Nordeste": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"),
    "Centro-Oeste": ("DF", "GO", "MS", "MT"),
    "Sudeste": ("ES", "MG", "RJ", "SP"),
    "Sul": ("PR", "RS", "SC"),
}
