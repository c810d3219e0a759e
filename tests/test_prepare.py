from pyspark.sql import functions as F

from basketry.operators import aggregates as agg
from basketry.operators import joins
from basketry.plans import dashboard, exploration, retention
from basketry.plans.prepare import prepared_fact
from tests.samples import sales_tables

DAY = "2020-01-01 10:00:00", "2020-01-05 09:00:00", "2020-01-04 00:00:00"


def test_two_reviews_repeat_the_items(spark):
    tables = sales_tables(spark, [("o1", "c1", *DAY)], [("o1", "p1", "s1", 10.0, 1.0)], [("o1", 1), ("o1", 5)])
    fact = prepared_fact(tables)
    assert agg.sum_price(fact, "order_id").first()["total_price"] == 20.0
    deduped = prepared_fact(tables, dedupe_reviews=True)
    assert [tuple(r) for r in deduped.select("price", "review_score").collect()] == [(10.0, 5.0)]


def test_median_ignores_removed_rows(spark, tmp_path):
    orders = [(f"o{i}", "c1", *DAY) for i in range(4)]
    items = [("o0", "p1", "s1", 0.0, 1.0), ("o1", "p1", "s1", 5.0, 1.0), ("o2", "p1", "s1", 5.0, 0.0), ("o3", "p1", "s1", 7.0, 0.0)]
    tables = sales_tables(spark, orders, items, [("o0", 1), ("o1", 4), ("o2", 4)])
    for path in (None, str(tmp_path / "fact")):
        fact = prepared_fact(tables, path=path)
        rows = {r["order_id"]: r["review_score"] for r in fact.collect()}
        assert rows == {"o1": 4.0, "o2": 4.0, "o3": 4.0}


def test_features_of_a_row(spark):
    tables = sales_tables(
        spark,
        [("o1", "c1", *DAY), ("o2", "c1", DAY[0], DAY[1], None), ("o3", "c1", DAY[0], None, DAY[2])],
        [(o, "p1", "s1", 10.0, 1.0) for o in ("o1", "o2", "o3")],
    )
    fact = prepared_fact(tables).orderBy("order_id")
    rows = [(r["order_id"], r["delivery_time"], r["is_late"], r["order_month"], r["day_of_week_int"]) for r in fact.collect()]
    assert rows == [("o1", 3, 1, "2020-01", 3), ("o2", 3, 0, "2020-01", 3)]
    assert tuple(fact.columns[:14]) == joins.PREPARED_COLUMNS


def test_null_categories_are_no_group(spark):
    tables = sales_tables(
        spark,
        [("o1", "c1", *DAY)],
        [("o1", "p1", "s1", 1.0, 1.0), ("o1", "p2", "s1", 2.0, 1.0), ("o1", "p3", "s1", 4.0, 1.0)],
        products=[("p1", "a"), ("p2", None), ("p3", "a")],
    )
    report = exploration.top_categories_revenue(prepared_fact(tables))
    assert [tuple(r) for r in report.collect()] == [("a", 5.0)]


def test_region_of_states(spark):
    states = spark.createDataFrame([("SP",), ("XX",), ("AM",)], "customer_state string")
    table = joins.with_region(states, joins.region_lookup(dashboard.STATES_OF_REGION))
    assert {tuple(r) for r in table.collect()} == {("SP", "Sudeste"), ("XX", None), ("AM", "Norte")}
    assert sum(map(len, dashboard.STATES_OF_REGION.values())) == 27


def test_retention(spark):
    orders = [("o1", "c1", "2020-01-01 12:00:00", *DAY[1:]), ("o2", "c1", "2020-01-11 11:00:00", "2020-02-01", None), ("o3", "c2", *DAY)]
    fact = prepared_fact(sales_tables(spark, orders, [(o[0], "p1", "s1", 3.0, 0.0) for o in orders]))
    row = retention.customer_retention(fact).first()
    assert (row["customers"], row["recurring_customers"], row["recurring_percent"]) == (2, 1, "50.00%")
    assert retention.days_first_to_last_order(fact).select("days_between_orders").collect() == [(9,)]


def test_retention_of_nobody_has_no_share(spark):
    fact = prepared_fact(sales_tables(spark, [("o1", "c1", *DAY)], [("o1", "p1", "s1", 3.0, 0.0)])).where("price < 0")
    assert retention.customer_retention(fact).first()["recurring_share"] is None


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, v double")
    top = agg.top_k(df, "v", "k", 2)
    assert [r["k"] for r in top.collect()] == ["c", "a"]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_merged_view_multiplies(spark):
    tables = sales_tables(spark, [("o1", "c1", *DAY)], [("o1", "p1", "s1", 10.0, 1.0)] * 2, [("o1", 1), ("o1", 5)])
    rows = joins.left_join_reviews(tables.orders.select("order_id"), tables.order_reviews)
    assert rows.count() == 2
    lone = tables.orders.select(F.lit("none").alias("order_id"))
    assert joins.left_join_reviews(lone, tables.order_reviews).first()["review_score"] is None


def test_scratch_goes_with_the_driver(tmp_path):
    """A driver of its own writes into the shared folder and leaves nothing there."""
    import subprocess
    import sys

    code = (
        "from basketry.session import build_session, scratch_path\n"
        f"s = build_session('t', 'local[1]', spark__ui__enabled='false', spark__checkpoint__dir='file://{tmp_path}')\n"
        "p = scratch_path(s, 'x')\n"
        "s.range(3).write.parquet(p)\n"
        "assert s.read.parquet(p).count() == 3\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=".")
    assert not [f for f in tmp_path.rglob("*") if f.is_file()]
