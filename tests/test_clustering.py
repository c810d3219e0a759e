import numpy as np
import pytest

from basketry.operators import cells, clustering
from basketry.plans import delay

AXES = ("x", "y")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    at = np.round(np.concatenate([rng.normal(c, 1.0, (60, 2)) for c in ((0, 0), (6, 1), (2, 8))]), 1)
    rows = [tuple(map(float, p)) for p in at] + [(0.0, 0.0)] * 40 + [(None, 1.0)]
    return spark.createDataFrame(rows, "x double, y double")


def plain_lloyd(at, centres, tol, max_iter=300):
    centres = np.array(centres, float)
    for _ in range(max_iter):
        own = ((at[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        moved = np.array([at[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        shift = ((moved - centres) ** 2).sum(1).max()
        centres = moved
        if shift <= tol**2:
            break
    return centres, ((at[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_all_restarts_at_once_equal_single_fits(spark, points, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 16)
    weighted = clustering.weighted_points(points, AXES).persist()
    start = clustering.first_centres(weighted, AXES, 3, range(10))
    assert (start == clustering.first_centres(weighted.repartition(3), AXES, 3, range(10))).all()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    found = clustering.lloyd(weighted, AXES, start, tol=1e-4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - jobs
    at = np.array([tuple(r) for r in points.na.drop().collect()])
    for r in range(10):
        centres, cost = plain_lloyd(at, start[r], 1e-4)
        np.testing.assert_allclose(found.centres[r], centres, atol=1e-9)
        assert found.costs[r] == pytest.approx(cost)
        assert found.sizes[r].sum() == len(at)
    # the jobs of all restarts together, not of each
    assert jobs <= 2 * (max(found.iterations) + 3) < sum(found.iterations)


def test_centres_without_points_stay(spark, points):
    weighted = clustering.weighted_points(points, AXES)
    found = clustering.lloyd(weighted, AXES, [[[0.0, 0.0], [500.0, 500.0]]])
    assert found.centres[0][1].tolist() == [500.0, 500.0] and found.sizes[0][1] == 0


def test_fewer_points_than_centres(spark):
    frame = spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double")
    weighted = clustering.weighted_points(frame, AXES)
    found = clustering.lloyd(weighted, AXES, clustering.first_centres(weighted, AXES, 2, [0]))
    assert found.costs == [0.0] and found.sizes.sum() == 3
    none = weighted.limit(0)
    assert clustering.lloyd(none, AXES, clustering.first_centres(none, AXES, 2, [0])).costs == [0.0]


def test_cells_hold_every_row(spark):
    rows = [(float(i % 50), 1.0, float(i * i), i % 2) for i in range(1000)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, late int")
    cuts = cells.cell_cuts(frame, ["a", "b", "c"], 8)
    counted = cells.cell_counts(cells.in_cells(frame, cuts), ["a", "b", "c"], "late").collect()
    assert sum(r.row_count for r in counted) == 1000 and len(counted) <= 2 * 8 * 8
    assert {r.b for r in counted} == {0.0} or len({r.b for r in counted}) == 1
    assert len({r.a for r in counted}) == 8
    assert cells.in_cells(frame, cuts).columns == frame.columns


def test_weights_stand_for_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), int(a + b > 6), int(rng.random() < (0.9 if a + b > 6 else 0.1))) for a, b in rng.integers(0, 6, (500, 2))]
    frame = spark.createDataFrame(rows, "price double, freight_value double, skip int, is_late int").drop("skip")
    names = ["price", "freight_value"]
    counted = cells.cell_counts(frame, names, "is_late")
    options = {"trees": 4, "rate": 0.1, "depth": 3, "seed": 1, "bins": 32}
    from pyspark.sql import functions as F

    by_cell = delay.fit_cells(counted, names, **options)
    by_row = delay.fit_cells(frame.withColumn("row_count", F.lit(1.0)), names, **options)
    np.testing.assert_allclose(by_cell.featureImportances.toArray(), by_row.featureImportances.toArray(), atol=1e-9)
    grid = delay.feature_vectors(counted, names)
    a, b = ([r.probability[1] for r in m.transform(grid).orderBy(*names, "is_late").collect()] for m in (by_cell, by_row))
    np.testing.assert_allclose(a, b, atol=1e-9)
