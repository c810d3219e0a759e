import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import neighbours, ordered, oversample

NAMES = ["a", "b", "c"]


def points(kind, n=240):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 1e4, (n, 3)) * [1, 0.1, 0.05]
    if kind == "copies":
        x = x.round(-2)
        x[: n // 3] = x[0]
    if kind == "crowd":
        x[: n // 3] = rng.normal(5000, 0.01, (n // 3, 3))
        x[-1] = [1e9, 0, 0]
    if kind == "line":
        x[:, 1:] = 7.0
    return x


def brute(x, k):
    out = []
    for i, q in enumerate(x):
        d = (q[0] - x[:, 0]) ** 2 + (q[1] - x[:, 1]) ** 2 + (q[2] - x[:, 2]) ** 2
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], *x[j]))
        out += [(*q, r, *x[j], d[j]) for r, j in enumerate(order[:k], 1)]
    return sorted(out)


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES))


@pytest.mark.parametrize("kind", ["uniform", "copies", "crowd", "line"])
def test_against_all_pairs(spark, kind):
    x = points(kind)
    got = sorted(tuple(r) for r in neighbours.neighbour_rows(frame(spark, x), NAMES, 5).collect())
    assert got == brute(x, 5)


def test_against_all_pairs_with_many_buckets_and_split_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_BUCKET", 30)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    x = points("crowd")
    got = sorted(tuple(r) for r in neighbours.neighbour_rows(frame(spark, x), NAMES, 3).collect())
    assert got == brute(x, 3)


def test_eight_features_visit_at_most_eight_cells(spark):
    rng = np.random.default_rng(8)
    names = [f"f{i}" for i in range(8)]
    x = rng.uniform(0, 1, (150, 8)) * rng.uniform(1, 50, 8)
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = {tuple(r[f] for f in names): set() for r in df.collect()}
    for r in neighbours.neighbour_rows(df, names, 4).collect():
        got[tuple(r[f] for f in names)].add((r["neighbour_rank"], round(r["distance2"], 9)))
    for i, q in enumerate(x):
        d = np.sort(((x - q) ** 2).sum(axis=1))[1:5]
        assert got[tuple(q)] == {(k + 1, round(v, 9)) for k, v in enumerate(d)}
    lows, side = neighbours._extent(df, names)
    assert len(lows) == 3
    level = F.floor(F.log2(F.lit(side) / (2 * F.col("_reach")))).cast("int")
    asked = df.withColumn("_reach", F.lit(side / 40) + F.col("f0") * 0).withColumn("_level", level)
    cells = neighbours.asked_cells(asked, lows, side)
    assert cells.groupBy(*names).count().agg(F.max("count")).first()[0] <= 8
    edges = cells.agg(*(F.min(f"_cell{d}") for d in range(3)), *(F.max(F.col(f"_cell{d}") - F.pow(F.lit(2.0), "_level")) for d in range(3))).first()
    assert min(edges[:3]) >= 0 and max(edges[3:]) <= -1


def test_equal_rows_are_neighbours_of_each_other(spark):
    x = np.array([[1.0, 1, 1]] * 3 + [[2.0, 1, 1], [9.0, 1, 1]])
    got = sorted(tuple(r) for r in neighbours.neighbour_rows(frame(spark, x), NAMES, 3).collect())
    assert got == brute(x, 3)


def test_numbering_covers_every_row_once(spark):
    x = points("copies")
    numbered = oversample.numbered_points(neighbours.distinct_points(frame(spark, x), NAMES), NAMES)
    taken = sorted(i for r in numbered.collect() for i in range(r["first_row"], r["first_row"] + r["copies"]))
    assert taken == list(range(len(x)))


def labelled(spark, majority, minority):
    x = points("uniform", majority + minority)
    labels = np.array([0] * majority + [1] * minority)
    return frame(spark, x).toPandas().assign(y=labels), x


@pytest.mark.parametrize("majority, minority", [(10, 6), (50, 7), (20, 19), (9, 9)])
def test_classes_are_balanced(spark, majority, minority):
    data, x = labelled(spark, majority, minority)
    result = oversample.smote_oversample(spark.createDataFrame(data), NAMES, "y")
    assert {r["y"]: r["count"] for r in result.groupBy("y").count().collect()} == {0: majority, 1: majority}
    made = [tuple(r[c] for c in NAMES) for r in result.where("synthetic").collect()]
    assert len(made) == majority - minority
    parents = x[majority:]
    for p in made:
        # on a segment between two minority rows
        gaps = [
            np.linalg.norm(np.array(p) - a) + np.linalg.norm(np.array(p) - b) - np.linalg.norm(a - b)
            for i, a in enumerate(parents)
            for b in parents[:i]
        ] + [np.linalg.norm(np.array(p) - a) for a in parents]
        assert min(gaps) < 1e-6


def test_too_few_minority_rows(spark):
    data, _ = labelled(spark, 12, 5)
    with pytest.raises(ValueError):
        oversample.smote_oversample(spark.createDataFrame(data), NAMES, "y")


def test_draws_repeat_no_row_and_use_several_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(*map(float, rng.uniform(0, 100, 3)), 1) for _ in range(1000)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, y int")
    made = oversample.synthetic_rows(frame, NAMES, 1000, 9000).cache()
    assert made.count() == 9000 and made.select(*NAMES).distinct().count() > 8900
    # draw i starts from row i mod n; its direction tells the neighbour
    by_base = {}
    numbered = oversample.numbered_points(neighbours.distinct_points(frame, NAMES), NAMES)
    base = {r.first_row: np.array([r.a, r.b, r.c]) for r in numbered.collect()}
    for r in made.collect():
        way = np.array([r.a, r.b, r.c]) - base[r.draw % 1000]
        by_base.setdefault(r.draw % 1000, set()).add(tuple((way / np.linalg.norm(way)).round(6)))
    assert all(len(d) > 1 for d in by_base.values())


def test_a_rare_class_is_drawn_in_many_tasks(spark):
    rows = [(float(i), float(i * i), 0.0, 1) for i in range(20)]
    made = oversample.synthetic_rows(spark.createDataFrame(rows, "a double, b double, c double, y int"), NAMES, 20, 2_000_000)
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000_000 and len(sizes) >= 8 and max(sizes) < 600_000


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_copies_of_a_hot_point_are_drawn_one_by_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(oversample, "DRAWS_PER_CHUNK", chunk)
    rows = [(1.0, 2.0, 3.0, 1)] * 40 + [(float(i), 0.0, 0.0, 1) for i in range(10)] + [(0.0, float(i), 5.0, 0) for i in range(180)]
    result = oversample.smote_oversample(spark.createDataFrame(rows, "a double, b double, c double, y int"), NAMES, "y")
    assert result.where("y = 1").count() == 180


def test_split_is_stable_and_near_its_share(spark):
    df = spark.range(10_000).withColumnRenamed("id", "row_key")
    train, test = oversample.train_test_split(df)
    again, _ = oversample.train_test_split(df.repartition(17))
    assert train.count() + test.count() == 10_000
    assert abs(train.count() - 7000) < 50
    assert train.exceptAll(again).count() == 0


def test_curve_needs_no_room_of_its_own(spark):
    df = frame(spark, points("uniform")).withColumn("v", F.col("a"))
    cuts = ordered.cut_points(df, "v", 8)
    assert len(cuts) == 7 and cuts == sorted(cuts)


@pytest.mark.parametrize("blocks", [200_000, 1])
def test_points_are_listed_at_levels_asked_near_them(spark, monkeypatch, blocks):
    """Clusters of very different density: lookups use many levels, each point is listed at few."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(10_000 * i, 10.0**-i, (150, 3)) for i in range(6)])
    listed, split = [], neighbours._split_crowded_cells

    def counted(asks, found, keys, n):
        listed.append((found.count(), asks.select("_level").distinct().count()))
        return split(asks, found, keys, n)

    monkeypatch.setattr(neighbours, "_split_crowded_cells", counted)
    monkeypatch.setattr(neighbours, "ASKED_BLOCKS", blocks, raising=False)
    monkeypatch.setattr(neighbours, "ASKS_PER_TASK", 100, raising=False)
    got = sorted(tuple(r) for r in neighbours.neighbour_rows(frame(spark, x), NAMES, 5).collect())
    assert got == brute(x, 5)
    (rows, levels), = listed
    assert levels > 8 and (blocks == 1 or rows < levels * len(x) / 4)
