"""The prepared fact that every report reads."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from basketry.functions import day_of_week, elapsed_days, late_flag, month_key
from basketry.operators.filters import (
    drop_missing_dates,
    fill_median,
    fill_missing,
    freight_not_negative,
    price_positive,
    small_domain_median,
)
from basketry.operators.joins import SalesTables, prepared_join
from basketry.sources.sinks import replace_table


def clean_rows(rows: DataFrame) -> DataFrame:
    return freight_not_negative(price_positive(drop_missing_dates(rows)))


def add_features(rows: DataFrame) -> DataFrame:
    bought, delivered = "order_purchase_timestamp", "order_delivered_customer_date"
    return rows.withColumns(
        {
            "delivery_time": elapsed_days(delivered, bought),
            "is_late": late_flag(delivered, "order_estimated_delivery_date"),
            "order_month": month_key(bought),
            "day_of_week_int": day_of_week(bought),
        }
    )


def prepared_fact(
    tables: SalesTables,
    dedupe_reviews: bool = False,
    extra: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """Joined, cleaned and enriched item rows; missing scores take the median of those rows.

    With a path the joined rows are written there once; the median and the reports read that
    table. Without one everything stays lazy, and the median runs the join a second time.
    """
    rows = add_features(clean_rows(prepared_join(tables, dedupe_reviews, extra)))
    if path is None:
        return fill_median(rows, "review_score")
    rows = replace_table(rows, path)
    return fill_missing(rows, "review_score", small_domain_median(rows, "review_score", now=True))
