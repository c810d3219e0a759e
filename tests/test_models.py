import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import scaling
from basketry.plans import delay, segments


def test_scaling_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 6.0)], "a double, b double")
    rows = scaling.standard_scale(df, ["a", "b"]).collect()
    assert [r["a_z"] for r in rows] == [0.0] * 3
    b = np.array([1.0, 2.0, 6.0])
    np.testing.assert_allclose([r["b_z"] for r in rows], (b - b.mean()) / b.std())


@pytest.fixture(scope="module")
def rfm(spark):
    rng = np.random.default_rng(2)
    centres = [(10, 2, 100, 4), (200, 2, 150, 2), (60, 6, 900, 4), (100, 4, 500, 3)]
    rows = [
        (f"c{i}", int(r + rng.integers(0, 20)), int(f + rng.integers(0, 2)), float(m + rng.uniform(0, 40)), float(s + rng.uniform(0, 0.5)))
        for i, (r, f, m, s) in enumerate(centres * 40)
    ]
    schema = "customer_unique_id string, recency bigint, frequency bigint, monetary double, satisfaction double"
    return spark.createDataFrame(rows, schema)


def test_segments_partition_the_customers(spark, rfm):
    found = segments.customer_segments(rfm, restarts=3)
    kept = segments.rfm_without_outliers(rfm)
    assert found.customers.count() == kept.count()
    assert {r["cluster"] for r in found.customers.select("cluster").distinct().collect()} == {0, 1, 2, 3}
    assert found.cost == min(found.restart_costs) and len(found.restart_costs) == 3
    # every row is nearest to its own centroid, and the cost is what the labels cost
    cost = 0.0
    for r in found.customers.collect():
        z = np.array([r[c] for c in segments.SCALED])
        gaps = [((z - np.array(c)) ** 2).sum() for c in found.centroids]
        assert int(np.argmin(gaps)) == r["cluster"]
        cost += min(gaps)
    assert cost == pytest.approx(found.cost)
    means = [r["monetary_mean"] for r in segments.cluster_summary(found.customers).orderBy("cluster").collect()]
    assert means == sorted(means)
    profile = segments.cluster_profile(found.customers)
    assert profile.agg(F.sum("customers")).first()[0] == kept.count()
    assert segments.cluster_frequencies(found.customers).agg(F.sum("row_count")).first()[0] == kept.count()


@pytest.mark.parametrize("split_first", [False, True])
def test_delay_model(spark, split_first):
    rng = np.random.default_rng(4)
    rows = [
        (f"o{i}", f"c{i}", "s", float(rng.uniform(1, 100)), float(rng.uniform(0, 9)), int(d), int(d > 20))
        for i, d in enumerate(rng.integers(0, 30, 600))
    ]
    schema = "order_id string, customer_unique_id string, seller_id string, price double, freight_value double, delivery_time bigint, is_late int"
    model = delay.delivery_delay_model(spark.createDataFrame(rows, schema), trees=5, split_first=split_first)
    assert model.features == ["price", "freight_value", "delivery_time"]
    importance = model.feature_importance().collect()
    assert importance[0]["feature"] == "delivery_time"
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0, abs=1e-5)
    assert model.auc().first()["auc"] > 0.95
    report = {r["class"]: r for r in model.report().collect()}
    assert report["accuracy"]["recall"] > 0.9
    assert report["macro avg"]["support"] == model.scored.count()
    last = model.roc().where("fpr = 1 AND tpr = 1")
    assert last.count() == 1
