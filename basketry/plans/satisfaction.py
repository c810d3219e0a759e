"""Review scores against delivery time and price."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry.functions import exact_mean, money_mean, round_digits
from basketry.operators.aggregates import count_by
from basketry.operators.distributions import box_stats, box_summaries, one_box
from basketry.operators.sizing import small_side

BY = "review_score"
VALUES = ("delivery_time", "price")


def satisfaction_vs_delivery_box(fact: DataFrame) -> DataFrame:
    return box_stats(fact, "delivery_time", BY)


def satisfaction_vs_price_box(fact: DataFrame) -> DataFrame:
    return box_stats(fact, "price", BY)


def score_distribution(fact: DataFrame) -> DataFrame:
    return count_by(fact, BY).orderBy(BY)


def _summaries(fact: DataFrame) -> DataFrame:
    return box_summaries(
        fact,
        VALUES,
        BY,
        delivery_time_mean=exact_mean("delivery_time", 0),
        delivery_time_std=F.stddev_samp(F.col("delivery_time").cast("double")),
        price_mean=money_mean("price"),
        price_std=F.stddev_samp("price"),
        order_rows=F.count("order_id"),
        row_count=F.count(F.lit(1)),
    )


def _stats(summaries: DataFrame) -> DataFrame:
    columns = []
    for v in VALUES:
        for name, source in (("mean", f"{v}_mean"), ("median", f"{v}_q2"), ("std", f"{v}_std")):
            columns.append(round_digits(source).alias(f"{v}_{name}"))
    return summaries.select(BY, *columns, "order_rows").orderBy(BY)


def satisfaction_stats(fact: DataFrame) -> DataFrame:
    """Mean, median and standard deviation of delivery time and price per score."""
    return _stats(_summaries(fact))


def satisfaction_reports(fact: DataFrame) -> dict[str, DataFrame]:
    """All reports on satisfaction from one set of passes over the fact."""
    summaries = small_side(_summaries(fact))
    return {
        "satisfaction_vs_delivery_box": one_box(summaries, "delivery_time", BY),
        "satisfaction_vs_price_box": one_box(summaries, "price", BY),
        "satisfaction_stats": _stats(summaries),
        "score_distribution": summaries.select(BY, "row_count").orderBy(BY),
    }
