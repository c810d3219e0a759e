"""Standard scaling and nearest centroids."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add (x − mean) / population deviation per column; a constant column becomes 0."""
    stats = df.agg(
        F.struct(
            *(F.avg(c).cast("double").alias(f"mean_{c}") for c in columns),
            *(F.stddev_pop(c).alias(f"std_{c}") for c in columns),
        )
    ).first()[0]
    scaled = {
        f"{c}{suffix}": (
            (F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"std_{c}"])
            if stats[f"std_{c}"]
            else F.lit(0.0)
        )
        for c in columns
    }
    return df.withColumns(scaled)


def nearest_centroid(
    df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]], name: str = "cluster"
) -> DataFrame:
    """Add the number of the closest centroid; ties go to the lower number."""

    def squared_distance(centroid: Sequence[float]):
        terms = [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centroid)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    choices = F.array(
        *(F.struct(squared_distance(v).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(centroids))
    )
    return df.withColumn(name, F.array_min(choices)["i"])
