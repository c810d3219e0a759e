"""What moves between tasks when the fact is joined."""

import re
from contextlib import contextmanager
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from basketry.operators import sizing
from basketry.operators.joins import PREPARED_COLUMNS, prepared_join
from basketry.plans import delay
from basketry.registry import queries
from tests.samples import sales_tables


@contextmanager
def setting(spark, key, value):
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sales(spark):
    orders = [(f"o{i}", f"c{i % 3}", "2020-01-01", "2020-01-05", "2020-01-09") for i in range(6)]
    items = [(f"o{i % 6}", f"p{i % 4}", f"s{i % 2}", 10.0 + i, 1.0) for i in range(12)]
    return sales_tables(spark, orders, items, [("o1", 4), ("o1", 2)])


def test_items_of_the_fact_move_by_their_order_only(spark):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        moved = set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan(prepared_join(sales(spark)))))
    assert moved == {"order_id"}


@pytest.mark.parametrize("limit", ["DIMENSION_ROWS", "DIMENSION_BYTES"])
def test_large_dimensions_are_shuffled_with_the_same_rows(spark, monkeypatch, limit):
    small = sorted(map(str, prepared_join(sales(spark)).collect()))
    monkeypatch.setattr(sizing, limit, 1)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        rows = prepared_join(sales(spark))
        assert "hashpartitioning(product_id" in plan(rows) and "BroadcastExchange" not in plan(rows)
        assert rows.columns == list(PREPARED_COLUMNS) and sorted(map(str, rows.collect())) == small


def test_large_partitions_are_cut_by_rows(spark):
    one = spark.range(0, 1000, 1, 1)
    cut = sizing.in_parts(one, 100)
    sizes = [len(p) for p in cut.rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 150
    assert cut.distinct().count() == 1000
    assert sizing.in_parts(one, 1000) is one


def test_rows_of_a_fit_are_held_in_small_parts(spark, monkeypatch):
    """The trees on single rows get partitions cut by rows, whatever the files of the fact."""
    held, fit = [], delay.fit_cells

    def seen(rows, *args, **options):
        held.append((rows.count(), rows.rdd.getNumPartitions()))
        return fit(rows, *args, **options)

    monkeypatch.setattr(delay, "fit_cells", seen)
    monkeypatch.setattr(queries, "in_parts", lambda df: sizing.in_parts(df, 20))
    rows = [(float(i % 97), float(i % 13), float(i % 31), int(i % 4 == 0), f"o{i}") for i in range(400)]
    fact = spark.createDataFrame(rows, "price double, freight_value double, delivery_time double, is_late int, order_id string")
    fact = fact.withColumns({c: F.col("order_id") for c in ("customer_unique_id", "seller_id")}).coalesce(1)
    row = queries.delay_cells_check(SimpleNamespace(fact=fact)).first()
    assert row["same_scores"] and row["same_importance"]
    count, parts = max(held)
    assert count == row["train_rows"] and count / parts <= 20
