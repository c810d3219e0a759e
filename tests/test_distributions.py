"""Binned densities and samples of a fixed size."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import distributions as dist, sampling
from basketry.operators.sampling import bottom_k


def column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(5)


def exact_curve(values, bins, points):
    x = np.array(values)
    width = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min(), x.max(), points)
    kernels = np.exp(-0.5 * ((at[:, None] - x[None, :]) / width) ** 2).sum(axis=1)
    height = (x.max() - x.min()) / bins / (width * math.sqrt(2 * math.pi))
    return at, kernels * height, len(x) * height


@pytest.mark.parametrize("tolerance", [1e-2, 1e-4, 1e-7])
@pytest.mark.parametrize("shape", ["uniform", "lognormal", "two far heaps"])
def test_binned_density_keeps_its_bound(spark, shape, tolerance):
    rng = random.Random(7)
    draws = {
        "uniform": lambda: rng.random() * 90 - 40,
        "lognormal": lambda: rng.lognormvariate(2, 1.5),
        "two far heaps": lambda: rng.gauss(0, 1) + rng.choice([0, 1e6]),
    }
    values = [draws[shape]() for _ in range(1500)] + [3.25] * 700
    rows = dist.binned_density(column(spark, [*values, None]), "x", 20, 50, tolerance).orderBy("point").collect()
    at, exact, height = exact_curve(values, 20, 50)
    assert [r.point for r in rows] == list(range(50))
    np.testing.assert_allclose([r.position for r in rows], at, rtol=1e-12, atol=1e-9)
    bound = rows[0].bound
    assert bound == pytest.approx(height * tolerance, rel=1e-6)
    # the last term is for rounding
    assert np.abs(np.array([r.density for r in rows]) - exact).max() <= bound + 1e-10 * height
    # a coarse grid is really used: the curve is not the exact one
    if tolerance == 1e-2 and shape == "uniform":
        assert np.abs(np.array([r.density for r in rows]) - exact).max() > 0


@pytest.mark.parametrize("values", [[], [None], [4.0], [4.0] * 9])
def test_no_curve_without_spread(spark, values):
    assert dist.binned_density(column(spark, values), "x", 10).count() == 0


def test_tolerance_must_be_positive(spark):
    with pytest.raises(ValueError):
        dist.binned_density(column(spark, [1, 2]), "x", 10, tolerance=0.0)


def test_rows_after_the_grid_do_not_grow_with_the_values(spark):
    """Twenty times the different values: the kernel sums still see the rows of the grid only."""
    df = spark.range(200_000).select((F.xxhash64("id") / 2.0**40).alias("x"))
    plan = dist.binned_density(df, "x", 20, tolerance=1e-3)
    plan.collect()
    width = df.agg(F.stddev_samp("x")).first()[0] * 200_000**-0.2
    low, high = df.agg(F.min("x"), F.max("x")).first()
    limit = (high - low) / (width * math.sqrt(8e-3)) + 2
    cells = df.select(F.floor((F.col("x") - low) / (width * math.sqrt(8e-3))).alias("c")).distinct().count()
    assert cells <= limit < 2_000
    assert abs(plan.agg(F.sum("density")).first()[0] / 199 * 20 - 200_000) < 6_000


def drawn(key, seed=""):
    return hashlib.md5(":".join([seed, *map(str, key)]).encode()).hexdigest()


@pytest.mark.parametrize("k", [0, 1, 7, 400, 999, 1000, 5000])
def test_sample_against_a_sort(spark, k):
    rows = [(i, f"k{i % 13}", i * 0.5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, _draw string, v double").repartition(6)
    got = bottom_k(df, ["id", "_draw"], k, "s")
    assert got.columns == df.columns
    want = sorted(rows, key=lambda r: drawn(r[:2], "s"))[:k]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_samples_of_parts_merge(spark):
    df = spark.range(3000).withColumn("v", F.col("id") % 7)
    parts = [bottom_k(df.where(F.col("id") % 3 == i), ["id"], 50) for i in range(3)]
    merged = bottom_k(parts[0].union(parts[1]).union(parts[2]), ["id"], 50)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, bottom_k(df.repartition(17), ["id"], 50).collect()))


def test_hot_null_and_repeated_keys(spark, monkeypatch):
    """All rows of one key share a draw; the limit is raised until enough rows are below it."""
    rows = [(None, float(i)) for i in range(600)] + [(1, None), (1, 2.0), (1, 2.0)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(4)
    order = sorted(rows, key=lambda r: (drawn(["" if r[0] is None else r[0]]), r[1] is not None, r[1] or 0))
    for k in (2, 3, 10, 601):
        found = sorted(map(str, map(tuple, bottom_k(df, ["id"], k).collect())))
        assert found == sorted(map(str, order[:k]))
    assert bottom_k(df.limit(0), ["id"], 5).count() == 0
    with pytest.raises(ValueError):
        bottom_k(df, ["id"], -1)


def test_the_sort_sees_few_rows(spark):
    df = spark.range(200_000)
    k = 100
    wanted = k + 10 * math.sqrt(k) + 50
    limit = int(wanted / 200_000 * 16**sampling.DIGITS)
    below = df.where(sampling.draw(["id"]) < f"{limit:0{sampling.DIGITS}x}").count()
    assert k <= below <= 2 * wanted
    assert bottom_k(df, ["id"], k).count() == k


def test_points_are_whole_without_a_sample(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else -float(i)) for i in range(20)], "id int, a double, b double")
    assert dist.scatter(df, "a", "b").count() == 20
    some = dist.scatter(df, "a", "b", {"twice": F.col("a") * 2}, sample=5, key=["id"])
    assert some.columns == ["x", "y", "twice"] and some.count() == 5
    with pytest.raises(ValueError):
        dist.scatter(df, "a", "b", sample=5)
