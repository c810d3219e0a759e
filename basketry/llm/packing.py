"""Packing into padded batches with optimal length buckets.

The lengths of all documents are counted into one histogram. Dynamic programming over it finds the
bucket boundaries with the least padding, every document being padded to the boundary of its bucket.
Inside a bucket, batches take as many documents as the token budget allows at that boundary.

The histogram has a proven size: lengths up to EXACT have a bin each, longer ones EXACT / 2 bins per
doubling, so it has at most EXACT * (1 + log2(longest / EXACT) / 2) rows, whatever the input. Batches need row numbers per bucket; a bucket may hold most rows, so rows are numbered inside
slots of a bucket, and the counts of the slots before give the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import cut_lineage, words
from basketry.operators.sizing import small_side

BUCKETS = 16
BUDGET = 16_384
EXACT = 4096
ROWS_PER_SLOT = 20_000


def word_tokens(text: Column) -> Column:
    """Length of a document in words, with one end mark; 1 for a null or empty text."""
    return (F.size(words(text)) + 1).cast("bigint")


def length_bin(length: Column) -> Column:
    """The length itself up to EXACT; beyond, the upper end of its bin, 2/EXACT of the length wide at most."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(length / (EXACT // 2)))).cast("bigint")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step) * step)


def best_boundaries(histogram: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """Boundaries (upper lengths) of at most ``buckets`` buckets with the least total padding.

    ``histogram`` has (upper length, documents, total length) per bin in rising order. The cost of a
    bucket of bins i+1..j is ``upper_j * (C_j - C_i) - (S_j - S_i)``; lines with slope -C_i in upper_j give
    the minimum over i, and both are monotone, so each layer takes linear time.
    """
    if not histogram:
        return []
    tops = [h[0] for h in histogram]
    counts, sums = [0], [0]
    for _, n, total in histogram:
        counts.append(counts[-1] + n)
        sums.append(sums[-1] + total)
    size = len(tops)
    best = [tops[j - 1] * counts[j] - sums[j] if j else 0 for j in range(size + 1)]
    choice = [[0] * (size + 1)]
    for _ in range(1, min(buckets, size)):
        layer, picks = [0] * (size + 1), [0] * (size + 1)
        hull: list[int] = []  # bins i whose line can still be the lowest
        head = 0

        def value(i: int, x: int, best: list[int] = best) -> int:
            return best[i] + sums[i] - x * counts[i]

        def useless(a: int, b: int, c: int, best: list[int] = best) -> bool:
            """Line b is nowhere below both a and c (slopes fall from a to c)."""
            ya, yb, yc = best[a] + sums[a], best[b] + sums[b], best[c] + sums[c]
            return (yc - ya) * (counts[b] - counts[a]) <= (yb - ya) * (counts[c] - counts[a])

        for j in range(1, size + 1):
            i = j - 1
            while len(hull) - head >= 2 and useless(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            x = tops[j - 1]
            while len(hull) - head >= 2 and value(hull[head + 1], x) <= value(hull[head], x):
                head += 1
            picks[j] = hull[head]
            layer[j] = x * counts[j] - sums[j] + value(hull[head], x)
        best = layer
        choice.append(picks)
    ends, j = [], size
    for picks in reversed(choice):
        if j == 0:
            break
        ends.append(tops[j - 1])
        j = picks[j]
    return sorted(set(ends))


def length_boundaries(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Best boundaries for a frame with the columns ``length`` and ``copies``; the rows read here are bounded by the bins."""
    bins = lengths.groupBy(length_bin(F.col("length")).alias("bin")).agg(
        F.max("length").alias("top"), F.sum("copies").alias("n"), F.sum(F.col("length") * F.col("copies")).alias("total")
    )
    return best_boundaries([(r.top, r.n, int(r.total)) for r in sorted(bins.collect(), key=lambda r: r.bin)], buckets)


def packed(
    docs: DataFrame,
    length: Column,
    doc_id: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch_id, place) per row of ``docs``.

    Buckets count from 0 by rising length; ``padded_to`` is the bucket's boundary; ``batch_id`` counts from 0
    over all buckets and ``place`` from 0 inside a batch. A batch holds budget // padded_to documents, and one
    alone if it is longer than the budget. Order inside a bucket is a fixed hash of the id. Rows that repeat
    an id and a length get places of their own, one after the other; null ids are one id. A null length
    counts as 0. An empty table gives an empty table; columns other than those named are not read.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(length.cast("bigint"), F.lit(0)).alias("length"))
    # repeated rows are one row with a count from here on
    slim = cut_lineage(slim.groupBy("doc_id", "length").agg(F.count("*").alias("copies")))
    bounds = length_boundaries(slim, buckets) or [0]
    slots = max(1, slim.count() // ROWS_PER_SLOT)
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("length")))
    mark = F.xxhash64("doc_id", "length")
    placed = slim.withColumns({"bucket": bucket, "mark": mark, "slot": F.pmod(mark, F.lit(slots))})
    counts = placed.groupBy("bucket", "slot").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", "slot", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    capacity = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1))))
    tops = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col("bucket") + 1)
    totals = counts.groupBy("bucket").agg(F.sum("rows").alias("rows")).withColumn("padded_to", tops)
    totals = totals.withColumn("capacity", capacity).withColumn("batches", F.ceil(F.col("rows") / F.col("capacity")))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    firsts = totals.select(
        "bucket", "padded_to", "capacity", F.coalesce(F.sum("batches").over(earlier), F.lit(0)).alias("first_batch")
    )
    inside = Window.partitionBy("bucket", "slot").orderBy("mark", "doc_id", "length")
    numbered = placed.withColumn("upto", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = numbered.join(small_side(bases), ["bucket", "slot"]).join(F.broadcast(firsts), "bucket")
    numbered = numbered.withColumn("start", F.col("base") + F.col("upto") - F.col("copies"))
    rows = numbered.select(
        "*", F.explode(F.expr("sequence(start, start + copies - 1)")).alias("row")
    )
    return rows.select(
        "doc_id",
        F.col("length").alias("n_tokens"),
        F.col("bucket").cast("int").alias("bucket"),
        "padded_to",
        (F.col("first_batch") + F.floor(F.col("row") / F.col("capacity"))).cast("bigint").alias("batch_id"),
        (F.col("row") % F.col("capacity")).cast("bigint").alias("place"),
    )


def padding_report(batches: DataFrame) -> DataFrame:
    """Documents, batches, tokens and padding per bucket."""
    return batches.groupBy("bucket", "padded_to").agg(
        F.count("*").alias("documents"),
        F.countDistinct("batch_id").alias("batches"),
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.col("padded_to") - F.col("n_tokens")).alias("padding"),
    )
