"""Totals of the wide view and of the dashboard from partial tables, beside the plain ones."""

import os

import pytest
from pyspark.sql import functions as F

from basketry.operators import factorised, joins
from basketry.plans import dashboard
from basketry.registry import tpch

SF_DIR = "/root/testdata/sf0.001"
tables_there = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SUMS = {"installments": ("payment_installments", "bigint"), "spend": ("price", "decimal(18,2)"), "scores": ("review_score", "bigint")}


@tables_there
@pytest.mark.parametrize("keys", [["order_id"], ["order_status"], ["customer_state", "seller_state"], ["payment_type"], ["product_category_name", "review_score"]])
def test_totals_equal_those_of_the_joined_rows(spark, keys):
    tables = tpch.sales_tables(spark, SF_DIR)
    rows = joins.merged_view(tables).dropna(subset=keys)
    expected = rows.groupBy(*keys).agg(
        F.count("*").alias("merged_rows"),
        *(F.sum(F.col(c).cast(kind)).alias(out) for out, (c, kind) in SUMS.items()),
        F.count_distinct("order_id").alias("order_count"),
    )
    found = factorised.merged_totals(tables, keys, SUMS)
    names = sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(map(tuple, expected.select(*names).collect()), key=repr)
    assert expected.count() > 0


@tables_there
def test_one_row_per_order_is_joined(spark):
    found = factorised.merged_totals(tpch.sales_tables(spark, SF_DIR), ["order_id"], SUMS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # each side is added up to one row per order before it is joined, and nothing after
    assert "Aggregate" not in plan.split("Join Inner")[0]
    assert plan.count("Aggregate [order_id") == 4


@tables_there
def test_unknown_columns_raise(spark):
    with pytest.raises(ValueError):
        factorised.merged_totals(tpch.sales_tables(spark, SF_DIR), ["no_such_column"], {})


def test_dashboard_from_one_scan_equals_its_single_reports(spark):
    rows = [
        ("o1", "SP", "2018-01", "toys", "s1", 10.0, 1.5, 5.0, 3, "x"),
        ("o1", "SP", "2018-01", "toys", "s2", 20.0, None, 5.0, 3, "x"),
        ("o1", "SP", "2018-01", "toys", "s1", 10.0, 1.5, 1.0, 3, "x"),
        ("o2", None, "2018-01", None, "s1", 7.25, 2.0, None, None, "x"),
        ("o3", "RJ", None, "books", None, 0.5, 0.0, 4.0, -2, "x"),
        ("o4", "RJ", "2018-02", "toys", "s2", 3.0, 0.25, 3.0, 9, "x"),
        # an order that bears two states counts in both
        ("o4", "SP", "2018-02", "books", "s2", 4.0, 0.75, 2.0, 9, "x"),
    ]
    schema = "order_id string, customer_state string, order_month string, product_category_name string, seller_id string, price double, freight_value double, review_score double, delivery_time int, order_count string"
    for fact in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        found = dashboard.dashboard_reports(fact)
        single = {
            "state_sales_table": dashboard.state_sales_table(fact),
            "sales_heatmap": dashboard.sales_heatmap(fact),
            "top_states_sales": dashboard.top_states_sales(fact),
            "monthly_sales": dashboard.monthly_sales(fact),
            "monthly_delivery_time": dashboard.monthly_delivery_time(fact),
            "top_categories": dashboard.top_categories(fact),
            "top_sellers": dashboard.top_sellers(fact),
        }
        assert set(found) == set(single)
        for name, frame in single.items():
            assert found[name].select(*frame.columns).collect() == frame.collect(), name
