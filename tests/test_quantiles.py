import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import distributions as dist
from basketry.operators import filters, quantiles, summaries
from basketry.operators.quantiles import exact_quantiles, quantile_values


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_known_answer(spark):
    assert quantile_values(column(spark, [1, 2, 3, 10, None]), "x", [0.25, 0.5, 0.75]) == [1.75, 2.5, 4.75]
    assert quantile_values(column(spark, [7]), "x", [0.0, 0.3, 1.0]) == [7.0] * 3
    assert quantile_values(column(spark, [None]), "x", [0.5]) == [None]


@pytest.mark.parametrize("accuracy, bracket_rows", [(50, 10**9), (200, 10**9), (10_000, 10**9), (50, 20), (200, 1)])
def test_groups_of_all_sizes_against_numpy(spark, monkeypatch, accuracy, bracket_rows):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", bracket_rows)
    rng = random.Random(5)
    sizes = {"one": 1, "two": 2, "few": 17, "some": 300, "many": 4000, "third": 9000}
    rows = []
    for group, n in sizes.items():
        for _ in range(n):
            # a third of the rows of a group are copies of one value
            rows.append((group, 42.0 if rng.random() < 0.33 else rng.lognormvariate(3, 2), rng.randint(0, 5)))
    rows += [("two", None, 1), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(13)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    targets = {f"x{i}": ("x", p) for i, p in enumerate(probabilities)} | {"k": ("k", 0.5)}
    found = {r["g"]: r for r in exact_quantiles(df, targets, ["g"], accuracy).collect()}
    assert set(found) == set(sizes)
    for group in sizes:
        x = [r[1] for r in rows if r[0] == group and r[1] is not None]
        k = [r[2] for r in rows if r[0] == group]
        np.testing.assert_array_equal([found[group][f"x{i}"] for i in range(len(probabilities))], np.quantile(x, probabilities))
        assert found[group]["k"] == np.median(k)


def test_groups_without_values_have_no_row(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), ("b", None, None), ("c", None, 2.0)], "g string, x double, y double")
    found = exact_quantiles(df, {"x": ("x", 0.5), "y": ("y", 0.5)}, ["g"])
    assert {tuple(r) for r in found.collect()} == {("a", 2.0, 5.0), ("c", None, 2.0)}


def test_narrowing_of_a_whole_column(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 10)
    values = [random.Random(i).lognormvariate(0, 3) for i in range(5000)] + [2.5] * 2500
    got = quantile_values(column(spark, values).repartition(7), "x", [0.05, 0.5, 0.95], accuracy=100)
    assert got == list(np.quantile(values, [0.05, 0.5, 0.95]))


def test_no_row_exchange_in_the_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    plan = quantiles._ranks(df, [("x", 0.5)], ["g"], 10_000, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "percentile" not in plan


def test_a_missed_rank_widens_the_brackets(spark, monkeypatch):
    sketch, asked = quantiles._sketch, []

    def bad(df, targets, by, accuracy, wider=1.0):
        asked.append(wider)
        found = sketch(df, targets, by, accuracy, wider)
        return found.withColumn("_high_0", F.col("_low_0")) if wider < 100 else found

    monkeypatch.setattr(quantiles, "_sketch", bad)
    values = [random.Random(i).random() for i in range(3000)]
    assert quantile_values(column(spark, values), "x", [0.5], accuracy=1000) == [np.quantile(values, 0.5)]
    assert asked == [1.0, 10.0, 100.0]
    asked.clear()
    monkeypatch.setattr(quantiles, "WIDER", (1.0, float("inf")))
    assert quantile_values(column(spark, values), "x", [0.5], accuracy=1000) == [np.quantile(values, 0.5)]


def test_iqr_of_zero_keeps_only_the_common_value(spark):
    kept = filters.filter_iqr(column(spark, [1, 1, 1, 1, 2]), "x")
    assert [r["x"] for r in kept.collect()] == [1.0] * 4


def test_iqr_in_turn_sees_survivors(spark):
    a = [1.0, 2.0, 3.0, 4.0, 100.0]
    b = [10.0, 11.0, 12.0, 40.0, 1000.0]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    expected = np.array(list(zip(a, b)))
    for i in (0, 1):
        q1, q3 = np.quantile(expected[:, i], [0.25, 0.75])
        inside = (expected[:, i] >= q1 - 1.5 * (q3 - q1)) & (expected[:, i] <= q3 + 1.5 * (q3 - q1))
        expected = expected[inside]
    kept = filters.filter_iqr_in_turn(df, ["a", "b"])
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, expected))


def test_histogram_edges(spark):
    rows = dist.histogram(column(spark, [0, 1, 2, 10, None]), "x", 5).orderBy("bin").collect()
    assert [r["row_count"] for r in rows] == [2, 1, 0, 0, 1]
    assert (rows[0]["low"], rows[-1]["high"]) == (0.0, 10.0)


def test_histogram_of_a_constant(spark):
    rows = dist.histogram(column(spark, [3, 3, 3]), "x", 30).where("row_count > 0").collect()
    expected, edges = np.histogram([3, 3, 3], 30)
    assert [(r["bin"], r["row_count"]) for r in rows] == [(int(np.argmax(expected)), 3)]


def test_density_against_formula(spark):
    x = np.array([1, 1, 2, 5, 9], dtype=float)
    got = np.array([r["density"] for r in dist.density(column(spark, x), "x", 4, 50).orderBy("point").collect()])
    width = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(1, 9, 50)
    kernel = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / width) ** 2).sum(axis=1)
    np.testing.assert_allclose(got, kernel / (len(x) * width * np.sqrt(2 * np.pi)) * len(x) * 2.0)


def test_box_with_outliers(spark):
    df = column(spark, [1, 2, 3, 4, 5, 50]).withColumn("g", F.lit("a"))
    row = dist.box_stats(df, "x", "g").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert (row["whisker_low"], row["whisker_high"], row["outliers"]) == (1.0, 5.0, 1)
    assert [r["x"] for r in dist.box_outliers(df, "x", "g").collect()] == [50.0]


def summary_rows(spark):
    rng = random.Random(11)
    rows = []
    for state, n in {"a": 1, "b": 3, "c": 700, "d": 9000}.items():
        for _ in range(n):
            x = None if rng.random() < 0.1 else 5.0 if rng.random() < 0.3 else rng.lognormvariate(1, 2)
            rows.append((state, rng.choice([1, 2, None]), x, rng.randrange(50)))
    rows += [(None, 1, 2.5, 7), ("empty", 2, None, None)]
    return rows, spark.createDataFrame(rows, "s string, g int, x double, k int").repartition(9)


@pytest.mark.parametrize("size, margin, bracket_rows", [(4096, 2.0, 10**6), (16, 2.0, 10**6), (64, 0.01, 10**6), (64, 2.0, 50)])
def test_one_summary_answers_exactly(spark, tmp_path, monkeypatch, size, margin, bracket_rows):
    """By two keys, by each and without: as numpy has it, also with brackets that miss or are narrowed."""
    monkeypatch.setattr(summaries, "MARGIN", margin)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", bracket_rows)
    rows, df = summary_rows(spark)
    summaries.quantile_summary(df, ["x", "k"], ["s", "g"], size).write.parquet(str(tmp_path / "t"))
    summary = spark.read.parquet(str(tmp_path / "t"))
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    targets = {f"x{i}": ("x", p) for i, p in enumerate(ps)} | {"k": ("k", 0.5)}
    for by in ([], ["s"], ["g"], ["s", "g"]):
        groups = {}
        for s, g, x, k in rows:
            key = tuple({"s": s, "g": g}[b] for b in by)
            if None not in key:
                xs, ks = groups.setdefault(key, ([], []))
                xs += [] if x is None else [x]
                ks += [] if k is None else [k]
        groups = {key: v for key, v in groups.items() if v[0] or v[1]}
        found = {tuple(r[b] for b in by): r for r in exact_quantiles(df, targets, by, summary=summary).collect()}
        assert set(found) == set(groups)
        for key, (xs, ks) in groups.items():
            want = list(np.quantile(xs, ps)) if xs else [None] * len(ps)
            assert [found[key][f"x{i}"] for i in range(len(ps))] == want
            assert found[key]["k"] == np.median(ks)


def test_estimates_keep_their_error_and_summaries_of_parts_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").cast("double").alias("x"))
    parts = [summaries.quantile_summary(df.where(F.col("g") == i), ["x"], ["g"], 512) for i in range(3)]
    whole = summaries.estimates(parts[0].union(parts[1]).union(parts[2]), {"m": ("x", 0.5), "t": ("x", 0.9)}).first()
    for value, p in ((whole.m, 0.5), (whole.t, 0.9)):
        assert abs(df.where(F.col("x") <= value).count() / 60_000 - p) < 3 * whole.rank_error
    none = summaries.quantile_summary(df.limit(0), ["x"])
    assert none.first().x_n == 0 and summaries.estimates(none, {"m": ("x", 0.5)}).first().m is None
    assert summaries.quantile_summary(df.limit(0), ["x"], ["g"]).count() == 0
