"""Connected components of an edge table, by rounds of star contraction.

A round hangs every node on the smallest node it sees (large star), then joins the smaller
neighbours of a node with each other (small star). Edges never multiply, a few rounds suffice for
any graph (logarithmic in practice), and every round ends in a written table. A checkpoint would not do:
it keeps the size that Spark estimated, for a join the product of both sides, so that a few rounds on the driver
would multiply numbers of millions of digits. Minima are checkpointed
before the join that hands them out, so that adaptive execution can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import cut_lineage, settled


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another node; the root is the smallest node of its component.

    ``a`` and ``b`` are of one ordered type. Rows with a null end, loops and repeated edges do no harm;
    without edges the result is empty.
    """
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    current = settled(current.distinct())
    before = None
    while True:
        now = _signature(current)
        if now == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select("v", "v").distinct()
            )
        before = now
        current = settled(_small_star(_large_star(current)))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of the neighbourhood."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut_lineage(moved.where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = least.select("u", F.col("m").alias("v"))
    return moved.union(hung).where("u != v").distinct()
