"""Predicting late deliveries."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions import round_digits
from basketry.operators.cells import CellCuts, cell_counts, cell_cuts, in_cells
from basketry.operators.filters import available, drop_missing_features
from basketry.operators.metrics import classification_report, confusion_matrix, roc_auc, roc_curve
from basketry.operators.oversample import hash_key, smote_oversample, train_test_split
from basketry.session import cut_lineage

# Features the model takes if the frame has them.
FEATURES = (
    "price", "freight_value", "delivery_time", "product_weight_g", "product_length_cm",
    "product_height_cm", "product_width_cm", "payment_installments",
)


# A pass over this many cells takes about as long as starting its task.
CELLS_PER_TASK = 50_000


def feature_rows(fact: DataFrame, wanted: Sequence[str] = FEATURES) -> DataFrame:
    """Numeric features that are present, the label, and a key to split rows by."""
    features = available(fact, wanted)
    rows = drop_missing_features(fact, features)
    parts = ("order_id", "customer_unique_id", "seller_id")
    key = hash_key(F.concat_ws(":", *(F.col(c).cast("string") for c in parts), *(_digits(f) for f in features)))
    return rows.select(
        *(F.col(f).cast("double").alias(f) for f in features), "is_late", key.alias("row_key")
    )


def _digits(feature: str) -> Column:
    """A number as text, in ten-thousandths, so that any engine writes it alike."""
    return F.floor(F.col(feature).cast("double") * 10000 + 0.5).cast("bigint").cast("string")


def feature_vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return assembler.transform(rows).withColumn("label", F.col("is_late").cast("double"))


@dataclass(frozen=True)
class CellTrees:
    """Boosted trees over the cells of binned features, and the cuts that make them."""

    model: GBTClassificationModel
    cuts: CellCuts


@dataclass(frozen=True)
class DelayModel:
    """A fitted classifier and its scored test rows."""

    trees: CellTrees
    features: list[str]
    scored: DataFrame

    def feature_importance(self) -> DataFrame:
        spark = self.scored.sparkSession
        pairs = list(zip(self.features, map(float, self.trees.model.featureImportances.toArray())))
        frame = spark.createDataFrame(pairs, "feature string, importance double")
        return frame.withColumn("importance", round_digits("importance")).orderBy(
            F.col("importance").desc(), "feature"
        )

    def confusion(self) -> DataFrame:
        return confusion_matrix(self.scored)

    def report(self) -> DataFrame:
        return classification_report(self.confusion())

    def auc(self) -> DataFrame:
        return roc_auc(self.scored, "probability", "label")

    def roc(self, drop_collinear: bool = True) -> DataFrame:
        return roc_curve(self.scored, "probability", "label", drop_collinear)


def fit_gbt(
    train: DataFrame,
    features: Sequence[str],
    trees: int = 100,
    rate: float = 0.1,
    depth: int = 5,
    seed: int = 42,
    fit_rows: int | None = None,
    bins: int = 32,
) -> CellTrees:
    """Boosted trees on all training rows, read as a table of weighted cells.

    Every feature is cut at its ``bins``-quantiles, as the trees do themselves; rows of one cell and label then share
    their residual in every round, so one row with their number as weight stands for them. The fit, which passes over
    its rows once per tree and level, reads at most 2 * bins ** len(features) rows however many there are.
    ``fit_rows`` bounds the rows that are counted, about that many taken by the hash of their key; by default all.
    """
    if fit_rows is not None:
        share = min(1.0, fit_rows / max(1, train.count()))
        train = train.where(hash_key(F.concat(F.lit("fit:"), F.col("row_key").cast("string"))) < int(share * 2**52))
    cuts = cell_cuts(train, features, bins)
    cells = cell_counts(in_cells(train, cuts), features, "is_late").persist()
    try:
        parts = max(1, cells.count() // CELLS_PER_TASK)
        return CellTrees(fit_cells(cells.coalesce(parts), features, trees, rate, depth, seed, bins), cuts)
    finally:
        cells.unpersist()


def fit_cells(
    cells: DataFrame, features: Sequence[str], trees: int, rate: float, depth: int, seed: int, bins: int
) -> GBTClassificationModel:
    """Boosted trees on rows with binned features, ``is_late`` and the weight ``row_count``."""
    classifier = GBTClassifier(
        maxIter=trees,
        stepSize=rate,
        maxDepth=depth,
        maxBins=bins,
        seed=seed,
        labelCol="label",
        featuresCol="features",
        weightCol="row_count",
        maxMemoryInMB=1024,
    )
    vectors = feature_vectors(cells, features).select("features", "label", "row_count").persist()
    try:
        return classifier.fit(vectors)
    finally:
        vectors.unpersist()


def score(fitted: CellTrees, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predicted class and the probability of being late; the features keep their values."""
    kept = F.struct(*features)
    scored = fitted.model.transform(feature_vectors(in_cells(rows.withColumn("given", kept), fitted.cuts), features))
    scored = scored.withColumn("probability", vector_to_array("probability")[1])
    return scored.select("given.*", "label", "prediction", "probability")


def delivery_delay_model(
    fact: DataFrame,
    wanted: Sequence[str] = FEATURES,
    trees: int = 100,
    train_share: float = 0.7,
    split_first: bool = False,
    seed: int = 42,
    split_seed: int = 0,
    fit_rows: int | None = None,
) -> DelayModel:
    """Balance the classes, split, fit boosted trees and score the test rows.

    Classes are balanced before the split, so synthetic rows reach the test rows too;
    ``split_first`` balances the training rows only. ``fit_rows`` bounds the rows that the trees are fitted to.
    """
    rows = feature_rows(fact, wanted)
    features = [c for c in rows.columns if c not in ("is_late", "row_key")]
    if split_first:
        train, test = train_test_split(rows, train_share=train_share, seed=split_seed)
        train = cut_lineage(smote_oversample(train, features, "is_late"))
    else:
        balanced = cut_lineage(smote_oversample(rows, features, "is_late"))
        train, test = train_test_split(balanced, train_share=train_share, seed=split_seed)
    fitted = fit_gbt(train, features, trees, seed=seed, fit_rows=fit_rows)
    return DelayModel(fitted, features, cut_lineage(score(fitted, test, features)))
