"""Time the headline queries and print one JSON line.

The fact is prepared once, as a user of the reports would; every report then reads it. All
queries are run once on the smallest tables first, so that the timings are not those of a cold JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.plans import dashboard, delay, exploration, retention, satisfaction, segments
from basketry.plans.prepare import prepared_fact
from basketry.registry import tpch
from basketry.session import build_session, scratch_path
from basketry.sources import readers, sinks

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_UP_DIR = os.environ.get("BENCH_WARM_UP_DIR", "/root/testdata/sf0.001")


def finish(*frames: DataFrame) -> None:
    for df in frames:
        df.write.format("noop").mode("overwrite").save()


def delay_report(fact: DataFrame, trees: int) -> None:
    model = delay.delivery_delay_model(fact, trees=trees)
    finish(model.report(), model.auc(), model.feature_importance(), model.roc())


def segmentation(fact: DataFrame) -> None:
    found = segments.customer_segments(segments.rfm_scores(fact))
    finish(*segments.segment_reports(found).values())


def reports(fact: DataFrame, regions: DataFrame, trees: int) -> dict[str, Callable[[], None]]:
    """The steps whose times the baseline lists, each with the queries it covers."""
    return {
        "monthly_orders": lambda: finish(exploration.monthly_orders(fact)),
        "delivery_time_distribution": lambda: finish(*exploration.delivery_time_distribution(fact)),
        "freight": lambda: finish(*exploration.freight_reports(fact).values()),
        "top_categories": lambda: finish(exploration.top_categories_revenue(fact)),
        "top_states": lambda: finish(exploration.top_states_avg_order_value(fact)),
        "retention": lambda: finish(*retention.retention_reports(fact).values()),
        "satisfaction": lambda: finish(*satisfaction.satisfaction_reports(fact).values()),
        "dashboard": lambda: finish(*dashboard.dashboard_reports(fact, regions).values()),
        "segmentation": lambda: segmentation(fact),
        "delay_model": lambda: delay_report(fact, trees),
    }


def run(spark: SparkSession, sf_dir: str, trees: int) -> dict[str, float]:
    times: dict[str, float] = {}

    def timed(name: str, step: Callable):
        start = time.perf_counter()
        result = step()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    name = os.path.basename(sf_dir)
    tables = tpch.sales_tables(spark, sf_dir)
    export = tpch.write_csv_catalog(spark, sf_dir, scratch_path(spark, name, "export"))
    timed(
        "import_tables",
        lambda: sinks.import_tables(readers.load_catalog(spark, export), scratch_path(spark, name, "import")),
    )
    fact = timed("prepared_fact", lambda: prepared_fact(tables, path=scratch_path(spark, name, "fact")))
    for step_name, step in reports(fact, tpch.regions(spark, sf_dir), trees).items():
        timed(step_name, step)
    return times


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_UP_DIR):
        run(spark, WARM_UP_DIR, trees=3)
    times = run(spark, SF_DIR, trees=100)
    result = {
        "metric": "total seconds of import, fact and reports",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
