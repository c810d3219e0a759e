"""Totals of the dashboard: different orders, and what moves for them."""

import re

from basketry.plans import dashboard
from tests.test_movement import plan


def fact(spark):
    rows = [
        ("a", "SP", "2020-01", "toys", 1, 1.25, 1.0, 4.0, 3),
        ("a", "SP", "2020-01", "toys", 2, 2.25, None, None, 5),
        ("a", "RJ", "2020-01", None, 1, 3.0, 2.0, 2.0, None),
        ("b", "RJ", "2020-02", "toys", 1, 4.0, 2.0, 5.0, 7),
        (None, "RJ", None, "arts", None, 8.0, 2.0, 5.0, 7),
    ]
    kind = "order_id string, customer_state string, order_month string, product_category_name string, seller_id int, price double, freight_value double, review_score double, delivery_time int"
    return spark.createDataFrame(rows, kind)


def test_dashboard_totals_count_different_orders(spark):
    rows = dashboard.dashboard_totals(fact(spark)).collect()
    found = {(r.total_of, str(r[r.total_of])): (r.order_count, r.total_price, r.mean_delivery_time) for r in rows}
    assert found == {
        ("customer_state", "SP"): (1, 3.5, 4.0),
        ("customer_state", "RJ"): (2, 15.0, 7.0),
        ("order_month", "2020-01"): (1, 6.5, 4.0),
        ("order_month", "2020-02"): (1, 4.0, 7.0),
        ("product_category_name", "toys"): (2, 7.5, 5.0),
        ("product_category_name", "arts"): (0, 8.0, 7.0),
        ("seller_id", "1"): (2, 8.25, 5.0),
        ("seller_id", "2"): (1, 2.25, 5.0),
    }


def test_measures_of_the_dashboard_do_not_move_with_their_orders(spark):
    """Only the order and the keys of an item are dealt out by its order."""
    text = plan(dashboard.dashboard_totals(fact(spark)))
    # one exchange holds an order id, and it deals by nothing else
    by_order = re.findall(r"Exchange hashpartitioning\(([^)]*order_id[^)]*)\)", text)
    assert len(by_order) == 1 and by_order[0].count("#") == 1
