"""Classifier metrics as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions import ratio
from basketry.operators.ordered import with_running_totals
from basketry.operators.sizing import small_side
from basketry.session import cut_lineage


def score_totals(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives, negatives and rows per different score, computed once."""
    labelled = df.select(F.col(score).cast("double").alias("score"), F.col(label).alias("_y")).dropna()
    totals = labelled.groupBy("score").agg(
        F.count_if(F.col("_y") == 1).alias("positives"),
        F.count_if(F.col("_y") != 1).alias("negatives"),
        F.count(F.lit(1)).alias("row_count"),
    )
    return cut_lineage(totals)


def _grand_totals(totals: DataFrame) -> Column:
    return totals.agg(
        F.struct(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    ).scalar()


def cumulative_rates(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positives when everything scored at least ``threshold`` is called positive."""
    totals = score_totals(df, score, label)
    running = with_running_totals(totals, "score", ["positives", "negatives"], descending=True)
    all_rows = _grand_totals(totals)
    return running.select(
        F.col("score").alias("threshold"),
        F.col("positives_to").alias("true_positives"),
        F.col("negatives_to").alias("false_positives"),
        ratio("negatives_to", all_rows["n"]).alias("fpr"),
        ratio("positives_to", all_rows["p"]).alias("tpr"),
    )


def average_ranks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rank of every different score, counted from 1; tied rows share the mean of their ranks."""
    running = with_running_totals(score_totals(df, score, label), "score", ["row_count"])
    rank = F.col("row_count_to") - (F.col("row_count") - 1) / 2
    return running.select("score", "positives", "negatives", "row_count", rank.alias("average_rank"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives, exact with ties."""
    ranks = average_ranks(df, score, label)
    wide = "decimal(19,0)"
    # twice the rank is a whole number, so the rank sum is exact
    double_ranks = (F.col("average_rank") * 2).cast(wide) * F.col("positives").cast(wide)
    sums = ranks.agg(
        F.sum(double_ranks).cast("double").alias("r2"),
        F.sum("positives").cast("double").alias("p"),
        F.sum("negatives").cast("double").alias("n"),
    )
    area = ratio(F.col("r2") / 2 - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n"))
    return sums.select(area.alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str, drop_collinear: bool = True) -> DataFrame:
    """ROC points by falling threshold, from (0, 0) at an infinite threshold.

    A point is collinear when the next score adds the same counts as its own. The first and the
    last score always stay.
    """
    totals = score_totals(df, score, label)
    points = with_running_totals(totals, "score", ["positives", "negatives"], descending=True)
    all_rows = _grand_totals(totals)
    if drop_collinear:
        here = Window.partitionBy("_bucket").orderBy(F.col("score").desc())
        # the successor of a bucket's last score is the first one of the next bucket
        step = F.struct("positives", "negatives")
        heads = points.groupBy("_bucket").agg(F.max_by(step, "score").alias("_head"))
        following = heads.select(
            "_bucket", F.lead("_head").over(Window.orderBy(F.col("_bucket").desc())).alias("_head")
        )
        next_step = F.coalesce(F.lead(step).over(here), F.col("_head"))
        first = F.col("positives_to") + F.col("negatives_to") == F.col("row_count")
        points = (
            points.join(F.broadcast(following), "_bucket")
            .withColumn("_next", next_step)
            .where(first | F.col("_next").isNull() | (F.col("_next") != step))
        )
    curve = points.select(
        F.col("score").alias("threshold"),
        ratio("negatives_to", all_rows["n"]).alias("fpr"),
        ratio("positives_to", all_rows["p"]).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(origin)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    pair = df.select(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    )
    return pair.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("row_count"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    Reads a confusion matrix, which has one row per pair of classes and is computed now.
    """
    c, n = F.col, F.col("row_count")
    matrix = small_side(matrix)
    sides = matrix.select(
        F.inline(
            F.array(
                *(
                    F.struct(c(k).alias("class"), is_label.alias("_actual"), n.alias("_n"), hit.alias("_hit"))
                    for k, is_label, hit in (
                        ("label", F.lit(True), F.when(c("label") == c("prediction"), n).otherwise(0)),
                        ("prediction", F.lit(False), F.lit(0).cast("bigint")),
                    )
                )
            )
        )
    )
    per_class = sides.groupBy("class").agg(
        F.sum("_hit").alias("hits"),
        F.coalesce(F.sum(F.when(c("_actual"), c("_n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~c("_actual"), c("_n"))), F.lit(0)).alias("called"),
    )
    zero = F.lit(0.0)
    per_class = per_class.withColumns(
        {
            "precision": F.coalesce(ratio("hits", "called"), zero),
            "recall": F.coalesce(ratio("hits", "support"), zero),
            "f1": F.coalesce(ratio(2 * c("hits"), c("called") + c("support")), zero),
        }
    )
    measures = ("precision", "recall", "f1")
    weight = {m: F.sum(c(m) * c("support")) / F.sum("support") for m in measures}
    accuracy = F.sum("hits") / F.sum("support")

    def average(name: str, values: dict[str, Column]) -> DataFrame:
        return per_class.agg(
            *(values[m].alias(m) for m in measures), F.sum("support").alias("support")
        ).select(F.lit(name).alias("class"), *measures, "support")

    classes = per_class.select(c("class").cast("string").alias("class"), *measures, "support")
    return (
        classes.unionByName(average("accuracy", {m: accuracy for m in measures}))
        .unionByName(average("macro avg", {m: F.avg(m) for m in measures}))
        .unionByName(average("weighted avg", weight))
    )
