"""All reports in one call: the fact is prepared once and every report is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from basketry.operators.joins import SalesTables
from basketry.plans import dashboard, delay, exploration, retention, satisfaction, segments
from basketry.plans.prepare import prepared_fact
from basketry.sources.sinks import write_reports


def all_reports(
    fact: DataFrame, regions: Column | DataFrame | None = None, trees: int = 100, restarts: int = 10
) -> dict[str, DataFrame]:
    """Every report on a prepared fact by name. The two models are fitted when this is called."""
    histogram, density = exploration.delivery_time_distribution(fact)
    found = segments.customer_segments(segments.rfm_scores(fact), restarts=restarts)
    model = delay.delivery_delay_model(fact, trees=trees)
    return {
        "monthly_orders": exploration.monthly_orders(fact),
        "delivery_time_histogram": histogram,
        "delivery_time_density": density,
        **exploration.freight_reports(fact),
        "top_categories_revenue": exploration.top_categories_revenue(fact),
        "top_states_avg_order_value": exploration.top_states_avg_order_value(fact),
        **retention.retention_reports(fact),
        **satisfaction.satisfaction_reports(fact),
        **dashboard.dashboard_reports(fact, regions),
        **segments.segment_reports(found),
        "delay_classification": model.report(),
        "delay_auc": model.auc(),
        "delay_roc": model.roc(),
        "delay_importance": model.feature_importance(),
    }


def write_everything(
    tables: SalesTables,
    base_path: str,
    regions: Column | DataFrame | None = None,
    fmt: str = "parquet",
    trees: int = 100,
    restarts: int = 10,
) -> dict[str, DataFrame]:
    """Prepare the fact below ``base_path`` and write every report beside it; the reports are returned."""
    fact = prepared_fact(tables, path=f"{base_path}/fact")
    reports = all_reports(fact, regions, trees, restarts)
    write_reports(reports, f"{base_path}/reports", fmt)
    return reports
