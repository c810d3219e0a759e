"""Hard negatives: rows of another label that score close below a positive, by cover trees over all rows.

Vectors become whole numbers, so scores are exact. Rows are dealt to cells around pivots (a bounded sample taken
by hash), a cell with more than ``BLOCK_ROWS`` rows to several blocks, and every block gets a cover tree, built
once and written. Anchors are the stated query set: blocks of ``ANCHORS`` of them meet each tree, whose bounds skip
what lies outside their windows. Two passes: the best rows of the anchor's own label, then for each of these
the best rows of other labels inside its window. A tree returns at most what an anchor may keep, so the
merge over trees is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import settled
from basketry.llm.covertree import Tree, best_of, built, narrowest, packed, unpacked

BLOCK_ROWS = 2048
ANCHORS = 1024
PIVOTS = 256  # at most
# Bytes of trees and of queries, as float64, that meet in one group at most (one of each at least).
MEETING_BYTES = 16 << 20
GROUPS_PER_CORE = 8

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's share of the positive's score, per cent

RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def labelled(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part; ``vec`` has whole numbers, floor of 256 times a component.

    Rows without an id or a label, without a vector, or with a missing or not finite component take no part. ``label``
    replaces the column of that name. Rows that repeat an id count one by one. The result is written, so ``row`` holds.
    """
    value = F.col("embedding")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & sound)
    return settled(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("vec_id"),
            (F.col("label") if label is None else label).cast("bigint").alias("label"),
            F.transform(value, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"),
        )
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; missing components at the end are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    line = np.repeat(np.arange(len(sizes)), sizes)
    out[line, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(column, pa.Array) else column.to_numpy().astype(np.int64)


def _up_to(n: int) -> Column:
    """A row for each of 0, ..., n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


class Forest:
    """Cover trees over all rows: a written table (block, tree), blocks numbered from 0."""

    def __init__(self, rows: DataFrame):
        square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
        count, width, longest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(square)).first()
        self.rows, self.blocks, self.width = rows, 0, width or 0
        # rows are short of this length by less than the rounding of a square root
        self.reach = float(np.sqrt(longest or 0.0)) * (1 + 1e-12)
        if count:
            self.trees = settled(self._built(count), long_rows=True)

    def _built(self, count: int) -> DataFrame:
        width, reach = self.width, self.reach
        wanted = min(PIVOTS, -(-count // BLOCK_ROWS))
        mark = F.xxhash64("vec", "vec_id")
        sample = self.rows.orderBy(mark, "row").limit(wanted).select("vec").toArrow()
        pivots = _matrix(sample.column(0), width)
        pivots = np.column_stack((pivots, np.sqrt(np.maximum(0.0, reach**2 - (pivots**2).sum(1)))))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = _matrix(batch.column(3), width)
                extra = np.sqrt(np.maximum(0.0, reach**2 - (points**2).sum(1)))
                # all lengths are equal, so the nearest pivot has the largest inner product
                cell = (points @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names)

        names = ["row", "vec_id", "label", "vec", "cell"]
        schema = "row bigint, vec_id bigint, label bigint, vec array<double>, cell bigint"
        placed = settled(self.rows.select(names[:4]).mapInArrow(nearest, schema))
        # one row per pivot, at most PIVOTS
        sizes = {r.cell: -(-r["count"] // BLOCK_ROWS) for r in placed.groupBy("cell").count().collect()}
        ends = np.cumsum([sizes.get(c, 0) for c in range(wanted)]).tolist()
        self.blocks = ends[-1]
        first = F.array(*(F.lit(e - sizes.get(c, 0)) for c, e in enumerate(ends)))
        parts = F.array(*(F.lit(max(1, sizes.get(c, 0))) for c in range(wanted)))
        cell = F.col("cell").cast("int")
        block = F.get(first, cell) + F.pmod(F.xxhash64("row"), F.get(parts, cell))

        def tree_of(table: pa.Table) -> pa.Table:
            ids, rows, labels = (_numbers(table.column(name)) for name in ("vec_id", "row", "label"))
            tree = built(_matrix(table.column("vec"), width), ids, rows, labels, reach)
            return pa.table({"block": table.column("block").slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary())})

        blocks = placed.select(block.cast("bigint").alias("block"), *names[:4])
        return blocks.groupBy("block").applyInArrow(tree_of, "block bigint, tree binary")

    def _meetings(self, chunks: int, windows: int) -> tuple[int, int]:
        """On how many shelves the trees stand and on how many piles the chunks of queries lie. A shelf meets a pile in one group."""
        pile = max(1, MEETING_BYTES // (ANCHORS * 8 * (self.width + 2 * windows + 2)))
        piles = -(-chunks // pile)
        shelf = max(1, MEETING_BYTES // (BLOCK_ROWS * 8 * (self.width + 3)))
        # fewer trees on a shelf while there are not enough groups for all cores
        groups = GROUPS_PER_CORE * self.rows.sparkSession.sparkContext.defaultParallelism
        shelf = max(1, min(shelf, self.blocks * piles // groups))
        return -(-self.blocks // shelf), piles

    def best(self, queries: DataFrame, windows: int, same: bool, k: int) -> DataFrame:
        """(query, window, score, row, vec_id): the first ``k`` rows in each window of each row of ``queries``.

        ``queries`` has (row, label, vec, low, high), the last two arrays of ``windows`` ends. Higher scores come first,
        equal ones by smaller id; ``place`` counts from 1.
        """
        width = self.width
        parts = max(1, -(-queries.count() // ANCHORS))

        def together(table: pa.Table) -> pa.Table:
            arrays = {name: _numbers(table.column(name)) for name in ("row", "label")}
            arrays["vec"] = narrowest(_matrix(table.column("vec"), width))
            arrays |= {name: _matrix(table.column(name), windows) for name in ("low", "high")}
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "queries": pa.array([packed(**arrays)], pa.binary())})

        chunk = F.pmod(F.xxhash64("row"), F.lit(parts)).alias("chunk")
        chunks = queries.select(chunk, "row", "label", "vec", "low", "high").groupBy("chunk").applyInArrow(together, "chunk bigint, queries binary")
        shelves, piles = self._meetings(parts, windows)

        def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
            shelf = [Tree.from_bytes(t.as_py()) for t in trees.column("tree")]
            found = [np.zeros((0, len(names)), np.int64)]
            for blob in queries.column("queries"):
                q = unpacked(blob.as_py())
                query, window, score, row, vec_id = best_of(shelf, q["vec"].astype(np.float64), q["row"], q["label"], q["low"], q["high"], same, k)
                found.append(np.column_stack((q["row"][query], window, score.astype(np.int64), row, vec_id)))
            return pa.table(dict(zip(names, np.concatenate(found).T)))

        names = ["query", "window", "score", "row", "vec_id"]
        asked = chunks.select(F.pmod("chunk", F.lit(piles)).alias("pile"), "queries").withColumn("shelf", _up_to(shelves))
        stored = self.trees.select(F.pmod("block", F.lit(shelves)).alias("shelf"), "tree").withColumn("pile", _up_to(piles))
        met = stored.groupBy("shelf", "pile").cogroup(asked.groupBy("shelf", "pile"))
        found = met.applyInArrow(search, ", ".join(f"{n} bigint" for n in names))
        order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``labelled``.

    ``anchor`` says which rows are anchors. An anchor's positives are its best other rows of the same label; for each, the
    best rows of other labels follow whose score lies within ``low`` and ``high`` per cent of the positive's. Scores
    are inner products, exact below 2**53; vectors of different length are as if filled with zeros. Equal scores
    come by smaller id. Anchors without positives, and positives without negatives, give no rows.
    """
    forest = Forest(rows)
    if not forest.blocks:
        return rows.sparkSession.createDataFrame([], RESULT)
    anchors = rows.where(anchor)
    whole = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    near = forest.best(anchors.withColumns({"low": whole[0], "high": whole[1]}), 1, True, positives)
    score = F.col("score")
    ends = near.select(
        F.col("query").alias("row"),
        F.col("vec_id").alias("positive_id"),
        F.col("place").alias("nth"),
        score.alias("positive_score"),
        F.ceil(score * low / F.lit(100)).cast("double").alias("low"),
        F.floor(score * high / F.lit(100)).cast("double").alias("high"),
    )
    ends = settled(ends)
    # one entry per positive, in their order; missing ones are windows that nothing fits
    nth = range(1, positives + 1)
    spans = ends.groupBy("row").agg(
        F.array(*(F.coalesce(F.max(F.when(F.col("nth") == n, F.col("low"))), F.lit(1.0)) for n in nth)).alias("low"),
        F.array(*(F.coalesce(F.max(F.when(F.col("nth") == n, F.col("high"))), F.lit(0.0)) for n in nth)).alias("high"),
    )
    below = forest.best(anchors.join(spans, "row"), positives, False, negatives).select(
        F.col("query").alias("row"),
        (F.col("window") + 1).alias("nth"),
        F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    named = ends.select("row", "nth", "positive_id", "positive_score").join(
        anchors.select("row", F.col("vec_id").alias("anchor_id")), "row"
    )
    return below.join(named, ["row", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def contract_label() -> Column:
    """The label of the contract: rows whose id is divisible by 7 carry the next of the ten labels."""
    label = F.col("label").cast("bigint")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


def sql() -> str:
    return """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank",
       vec_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY "rank" <= 3
"""
