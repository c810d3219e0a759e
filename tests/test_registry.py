"""Registered queries against their SQL on the small tables, when those are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from basketry.registry import oracle, queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

QUERIES, ORACLE = queries.registered(), oracle.registered()
# fitted models have no SQL; what must hold for them has, in the queries named _check
WITHOUT_SQL = {
    "customer_segments",
    "delivery_delay_model",
    "feature_importance",
    "gbt_classifier",
    "kmeans_segments",
    "probability_column",
    "segment_summary",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def by_name(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    rows = [tuple(r[i] for i in order) for r in rows]
    return sorted(rows, key=lambda r: tuple((v is None, str(v) if not isinstance(v, (int, float)) else "", v if isinstance(v, (int, float)) else 0) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, database, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = database.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, expected = by_name(df.collect(), df.columns), by_name(cursor.fetchall(), columns)
    assert len(got) == len(expected)
    wrong = [(g, e) for g, e in zip(got, expected) if not all(map(same, g, e))]
    assert not wrong, wrong[:3]


def test_entry_points_have_every_query():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["order_month", "order_count"]


def test_plans_hold_no_python(spark):
    for name in ("prepared_fact", "rfm_scores", "roc_curve", "satisfaction_stats", "smote_oversample"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_agreed_numbers(spark):
    """Numbers two engines agreed on before this library was written."""
    sf = "/root/testdata/sf0.01"
    fact = QUERIES["prepared_fact"](spark, sf)
    row = fact.selectExpr(
        "count(*)", "count(DISTINCT order_id)", "count(DISTINCT customer_unique_id)", "sum(is_late)",
        "sum(review_score)", "sum(day_of_week_int)", "min(delivery_time)", "max(delivery_time)", "sum(delivery_time)",
    ).first()
    assert tuple(row) == (40110, 9743, 1497, 20094, 113949.0, 161400, -2384, 2478, 1367769)
    assert QUERIES["rfm_without_outliers"](spark, sf).count() == 1375
    assert QUERIES["roc_auc"](spark, sf).first()["auc"] == pytest.approx(0.502123, abs=1e-6)
    boxes = {r["is_same_state"]: r for r in QUERIES["freight_same_state_box"](spark, sf).collect()}
    assert boxes[False]["median"] == pytest.approx(2106.064309, abs=1e-6)
    assert (boxes[False]["outliers"], boxes[True]["outliers"]) == (24, 2)
    bars = {r["position"]: r["y"] for r in QUERIES["delivery_time_distribution"](spark, sf).where("part = 'bar'").collect()}
    assert (bars[0], bars[1], bars[10]) == (113, 287, 1894)
