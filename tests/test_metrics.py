import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from basketry.operators import metrics
from basketry.operators import ordered


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def brute_curve(rows):
    rows = sorted(rows, reverse=True)
    p = sum(y for _, y in rows)
    n = len(rows) - p
    points, tp, fp = [], 0, 0
    for i, (s, y) in enumerate(rows):
        tp, fp = tp + y, fp + 1 - y
        if i + 1 == len(rows) or rows[i + 1][0] != s:
            points.append((s, tp, fp))
    keep = [
        i
        for i in range(len(points))
        if i in (0, len(points) - 1)
        or any(points[i + 1][k] - 2 * points[i][k] + points[i - 1][k] for k in (1, 2))
    ]
    return [(points[i][0], points[i][2] / n, points[i][1] / p) for i in keep]


def test_tied_scores(spark):
    df = scored(spark, [(0.5, 0), (0.5, 1)])
    assert metrics.roc_auc(df, "score", "label").first()["auc"] == 0.5
    points = {tuple(r) for r in metrics.roc_curve(df, "score", "label").collect()}
    assert points == {(math.inf, 0.0, 0.0), (0.5, 1.0, 1.0)}


@pytest.mark.parametrize("buckets", [1, 7])
def test_curve_and_area_over_many_buckets(spark, monkeypatch, buckets):
    rng = random.Random(3)
    rows = [(0.25, rng.randint(0, 1)) for _ in range(100)]
    for _ in range(400):
        label = rng.randint(0, 1)
        rows.append((round(rng.gauss(label, 1), 2), label))
    monkeypatch.setattr(ordered, "ROWS_PER_BUCKET", max(1, 250 // buckets))
    df = scored(spark, rows).repartition(5)
    got = sorted((tuple(r) for r in metrics.roc_curve(df, "score", "label").collect()), reverse=True)
    assert got[0] == (math.inf, 0.0, 0.0)
    assert got[1:] == brute_curve(rows)
    area = metrics.roc_auc(df, "score", "label").first()["auc"]
    full = sorted(
        ((r["fpr"], r["tpr"]) for r in metrics.roc_curve(df, "score", "label", drop_collinear=False).collect())
    )
    trapezoid = sum((b[0] - a[0]) * (b[1] + a[1]) / 2 for a, b in zip(full, full[1:]))
    assert area == pytest.approx(trapezoid)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert area == pytest.approx(evaluator.evaluate(df.withColumn("label", F.col("label").cast("double"))))


def test_average_ranks(spark):
    ranks = metrics.average_ranks(scored(spark, [(1.0, 0), (2.0, 1), (2.0, 0), (9.0, 1)]), "score", "label")
    assert {r["score"]: r["average_rank"] for r in ranks.collect()} == {1.0: 1.0, 2.0: 2.5, 9.0: 4.0}


def test_report_matches_evaluators(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 9 + [(1, 0)] * 3
    df = spark.createDataFrame(rows, "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(metrics.confusion_matrix(df)).collect()}
    doubles = df.select(*(F.col(c).cast("double") for c in df.columns))

    def measure(name, label=0.0):
        return MulticlassClassificationEvaluator(metricName=name, metricLabel=label).evaluate(doubles)

    for c in (0, 1):
        assert report[str(c)]["precision"] == pytest.approx(measure("precisionByLabel", float(c)))
        assert report[str(c)]["recall"] == pytest.approx(measure("recallByLabel", float(c)))
        assert report[str(c)]["f1"] == pytest.approx(measure("fMeasureByLabel", float(c)))
    assert report["accuracy"]["precision"] == pytest.approx(measure("accuracy"))
    assert report["weighted avg"]["precision"] == pytest.approx(measure("weightedPrecision"))
    assert report["weighted avg"]["f1"] == pytest.approx(measure("f1"))
    assert [report[c]["support"] for c in ("0", "1", "macro avg")] == [7, 12, 19]


def test_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(metrics.confusion_matrix(df)).collect()}
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["f1"]) == (0.0, 0.0, 0.0)
