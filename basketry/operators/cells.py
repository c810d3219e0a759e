"""Rows as weighted cells of binned features."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

# Rank error of a cut, as a share of a bin.
CUT_ERROR = 1 / 8


@dataclass(frozen=True)
class CellCuts:
    """Ascending inner cuts per feature; a value belongs to the bin of the last cut that is not above it."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]


def cell_cuts(df: DataFrame, features: Sequence[str], bins: int) -> CellCuts:
    """Cuts at the quantiles that give each bin about the same number of rows, from one pass over all rows."""
    shares = [i / bins for i in range(1, bins)]
    found = df.approxQuantile(list(features), shares, CUT_ERROR / bins)
    return CellCuts(tuple(features), tuple(tuple(sorted(set(values))) for values in found))


def in_cells(df: DataFrame, cells: CellCuts) -> DataFrame:
    """The frame with every feature replaced by its bin, a double from 0."""
    cut = {f: cuts for f, cuts in zip(cells.features, cells.cuts) if cuts}
    if cut:
        ends = float("-inf"), float("inf")
        names = {f: f"_bin_{f}" for f in cut}
        bucketizer = Bucketizer(
            splitsArray=[[ends[0], *cuts, ends[1]] for cuts in cut.values()],
            inputCols=list(cut),
            outputCols=list(names.values()),
            handleInvalid="error",
        )
        df = bucketizer.transform(df).withColumns({f: F.col(n) for f, n in names.items()}).drop(*names.values())
    return df.withColumns({f: F.lit(0.0) for f in cells.features if f not in cut})


def cell_counts(binned: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One row per cell and label with its number of rows."""
    return binned.groupBy(*features, label).agg(F.count(F.lit(1)).cast("double").alias("row_count"))
