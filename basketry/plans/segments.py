"""Customer segments from recency, frequency, monetary value and satisfaction."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from basketry.functions.numbers import MEASURE_SCALE
from basketry.functions import elapsed_days, exact_mean, money_sum, round_digits
from basketry.operators.aggregates import distinct_orders, group, latest_purchase, value_counts
from basketry.operators.clustering import first_centres, lloyd, weighted_points
from basketry.operators.filters import filter_iqr_in_turn
from basketry.operators.quantiles import exact_quantiles
from basketry.operators.scaling import nearest_centroid, standard_scale
from basketry.session import cut_lineage

MEASURES = ("recency", "frequency", "monetary", "satisfaction")
SCALED = tuple(f"{m}_z" for m in MEASURES)


def rfm_scores(fact: DataFrame) -> DataFrame:
    """One row per customer: days since the last order, orders, spend and mean score."""
    customers = group(
        fact,
        ["customer_unique_id"],
        last_order=F.max("order_purchase_timestamp"),
        frequency=distinct_orders(),
        monetary=money_sum("price"),
        satisfaction=exact_mean("review_score"),
    )
    return customers.select(
        "customer_unique_id",
        elapsed_days(latest_purchase(fact), "last_order").alias("recency"),
        "frequency",
        "monetary",
        "satisfaction",
    )


def rfm_without_outliers(rfm: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Outliers removed measure by measure; the customer frame is computed once for all of them."""
    return filter_iqr_in_turn(cut_lineage(rfm), measures)


def scaled_rfm(rfm: DataFrame) -> DataFrame:
    return standard_scale(rfm, MEASURES)


@dataclass(frozen=True)
class Segmentation:
    """The labelled customers, and fitted centroids in scaled units ordered by spend."""

    customers: DataFrame
    rows: int
    centroids: list[list[float]]
    cost: float
    restart_costs: list[float]


def fit_kmeans(
    scaled: DataFrame,
    k: int = 4,
    seed: int = 42,
    restarts: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> tuple[list[list[float]], list[float]]:
    """The centres of the best of several restarts by total squared distance, and the costs of all."""
    points = weighted_points(scaled, SCALED).persist()
    try:
        start = first_centres(points, SCALED, k, [seed + r for r in range(restarts)])
        found = lloyd(points, SCALED, start, max_iter, tol)
    finally:
        points.unpersist()
    best = min(range(restarts), key=found.costs.__getitem__)
    return found.centres[best].tolist(), found.costs


def customer_segments(
    rfm: DataFrame, k: int = 4, seed: int = 42, restarts: int = 10, measures: Sequence[str] = MEASURES
) -> Segmentation:
    """Outlier removal, scaling and clustering; cluster 0 is the one that spends least."""
    kept = rfm_without_outliers(rfm, measures)
    rows = kept.count()
    scaled = scaled_rfm(kept)
    centres, costs = fit_kmeans(scaled, k, seed, restarts)
    spend = MEASURES.index("monetary")
    centroids = sorted(centres, key=lambda c: c[spend])
    labelled = nearest_centroid(scaled, SCALED, centroids)
    return Segmentation(labelled, rows, centroids, min(costs), costs)


def cluster_summary(segments: DataFrame) -> DataFrame:
    """Mean and median of every measure, and the size, per cluster."""
    medians = exact_quantiles(segments, {f"{m}_median": (m, 0.5) for m in MEASURES}, ["cluster"])
    means = group(
        segments,
        ["cluster"],
        **{f"{m}_mean": exact_mean(m, MEASURE_SCALE) for m in MEASURES},
        customers=F.count("customer_unique_id"),
    )
    columns = [f"{m}_{s}" for m in MEASURES for s in ("mean", "median")]
    return means.join(medians, "cluster", "left").select(
        "cluster", *(round_digits(c).alias(c) for c in columns), "customers"
    )


def cluster_profile(segments: DataFrame) -> DataFrame:
    """Size and means per cluster, all clusters in one pass."""
    return group(
        segments,
        ["cluster"],
        customers=F.count(F.lit(1)),
        **{f"{m}_mean": exact_mean(m, MEASURE_SCALE) for m in MEASURES},
    )


def cluster_members(segments: DataFrame, cluster: int) -> DataFrame:
    return segments.where(F.col("cluster") == cluster)


def cluster_frequencies(segments: DataFrame) -> DataFrame:
    return value_counts(segments, ["cluster"], "frequency")


def segment_reports(found: Segmentation) -> dict[str, DataFrame]:
    return {
        "cluster_summary": cluster_summary(found.customers),
        "cluster_profile": cluster_profile(found.customers),
        "cluster_frequencies": cluster_frequencies(found.customers),
        "segment_points": segment_points(found.customers),
    }


def segment_points(segments: DataFrame) -> DataFrame:
    """Recency against spend, coloured by cluster."""
    return segments.select(F.col("recency").alias("x"), F.col("monetary").alias("y"), "cluster")
