"""Balancing classes with synthetic rows, and splitting rows for training."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.operators.neighbours import distinct_points, nearest_neighbours
from basketry.session import cut_lineage

# Fixed values of the arithmetic split.
SPLIT_FACTOR = 7919
# Hexadecimal digits of a draw's hash that choose the neighbour and the gap.
RANK_DIGITS, GAP_DIGITS = (1, 8), (9, 8)
SCATTER_FACTORS = (7919, 104729, 1299709)
SCATTER_RANGE = 1_000_003
NUMBERING_BUCKETS = 16_384
DRAWS_PER_CHUNK = 10_000
DRAWS_PER_TASK = 500_000


def append_rows(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return df.unionByName(extra)


def _scatter(features: Sequence[str]) -> Column:
    """A number in a fixed range that neighbouring points do not share, from whole 1/10000ths."""
    terms = [
        F.pmod(F.floor(F.col(f) * 10000 + 0.5), F.lit(SCATTER_RANGE)) * SCATTER_FACTORS[i % len(SCATTER_FACTORS)]
        for i, f in enumerate(features)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.pmod(total, F.lit(SCATTER_RANGE))


def numbered_points(points: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct points with the row numbers ``first_row`` … ``first_row + copies - 1``.

    Rows are numbered from 0 in the order of a scattered key and then of the features. The key
    spreads evenly, so the numbering runs in many tasks of similar size.
    """
    points = points.withColumn("_key", _scatter(features))
    width = SCATTER_RANGE // NUMBERING_BUCKETS + 1
    points = points.withColumn("_bucket", F.floor(F.col("_key") / width).cast("int"))
    totals = points.groupBy("_bucket").agg(F.sum("copies").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most NUMBERING_BUCKETS rows
    offsets = F.broadcast(
        totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy("_bucket")
        .orderBy("_key", *features)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.coalesce(F.sum("copies").over(inside), F.lit(0)) + F.col("_offset")
    return points.join(offsets, "_bucket").select(*features, "copies", first.alias("first_row"))


def synthetic_rows(
    minority: DataFrame, features: Sequence[str], minority_rows: int, needed: int, k: int = 5
) -> DataFrame:
    """``needed`` rows on the segments between minority rows and one of their k neighbours.

    Draw i takes row i mod n in round i div n. The MD5 of "row:round" gives the rank of the neighbour and how far the
    new row moves towards it, in steps of 2^-32, so repeated draws of a row differ and a task that runs
    again draws the same.
    """
    if minority_rows <= k:
        raise ValueError(f"{minority_rows} minority rows are too few for {k} neighbours")
    points = cut_lineage(distinct_points(minority, features))
    bases = numbered_points(points, features)
    if needed < minority_rows:
        # only rows that are drawn need neighbours
        bases = bases.where(F.col("first_row") < needed)
    bases = cut_lineage(bases)
    found = nearest_neighbours(points, features, k, queries=bases)

    # a point has at most k neighbours, and meets them before its draws are unfolded
    listed = found.groupBy(*features).agg(
        F.collect_list(F.struct("rank_from", "rank_to", "neighbour")).alias("_near")
    )
    rounds = -(-needed // minority_rows)
    row = F.col("first_row") + F.col("_copy")
    draws = _unfolded(bases.join(listed, list(features)), features, rounds, needed).withColumns(
        {
            "draw": row + F.col("_round") * minority_rows,
            "_hash": F.md5(F.concat_ws(":", row.cast("string"), F.col("_round").cast("string"))),
        }
    )
    rank = _digits(RANK_DIGITS) % k + 1
    chosen = F.filter("_near", lambda x: F.col("_rank").between(x["rank_from"], x["rank_to"]))[0]["neighbour"]
    gap = _digits(GAP_DIGITS) / float(16 ** GAP_DIGITS[1])
    return (
        draws.where(F.col("draw") < needed)
        .withColumn("_rank", rank)
        .withColumn("_other", chosen)
        .select(*((F.col(f) + gap * (F.col("_other")[f] - F.col(f))).alias(f) for f in features), "draw")
    )


def _digits(place: tuple[int, int]) -> Column:
    """A whole number from hexadecimal digits of the draw's hash."""
    return F.conv(F.substring("_hash", *place), 16, 10).cast("bigint")


def _unfolded(points: DataFrame, features: Sequence[str], rounds: int, needed: int) -> DataFrame:
    """A row per point, copy ``_copy`` and round ``_round``.

    The draws of a point are cut into chunks first and the chunks dealt out by number of draws, so that
    neither a crowd of copies nor a class with few points is unfolded in one task.
    """
    last_draw = F.col("copies") * rounds - 1
    step = F.lit(DRAWS_PER_CHUNK).cast("bigint")
    chunks = points.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), last_draw, step)))
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, -(-needed // DRAWS_PER_TASK))
    chunks = chunks.repartition(tasks, "_from", *features)
    last = F.least(F.col("_from") + DRAWS_PER_CHUNK - 1, last_draw)
    unfolded = chunks.withColumn("_at", F.explode(F.sequence(F.col("_from"), last)))
    return unfolded.withColumns(
        {"_copy": F.col("_at") % F.col("copies"), "_round": F.expr("_at div copies")}
    )


def smote_oversample(
    df: DataFrame, features: Sequence[str], label: str, k: int = 5
) -> DataFrame:
    """Both classes at the size of the larger one; new rows carry ``synthetic`` = true.

    ``row_key`` tells rows apart for a later split: it is kept if the frame has it, and synthetic
    rows get one from their draw.
    """
    sizes = df.groupBy(label).count().orderBy("count", label).collect()
    if len(sizes) != 2:
        raise ValueError("two classes are needed")
    small, large = sizes
    kept = ["row_key"] if "row_key" in df.columns else []
    originals = df.select(
        *(F.col(f).cast("double").alias(f) for f in features), label, *kept, F.lit(False).alias("synthetic")
    )
    needed = large["count"] - small["count"]
    if needed == 0:
        return originals
    minority = df.where(F.col(label) == small[label])
    made = synthetic_rows(minority, features, small["count"], needed, k)
    keys = [hash_key(F.concat(F.lit("synthetic:"), F.col("draw").cast("string"))).alias("row_key")] if kept else []
    made = made.select(
        *features,
        F.lit(small[label]).cast(df.schema[label].dataType).alias(label),
        *keys,
        F.lit(True).alias("synthetic"),
    )
    return append_rows(originals, made)


def hash_key(text: Column) -> Column:
    """A whole number below 2^52 from a text: 13 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def with_split(df: DataFrame, key: str = "row_key", train_share: float = 0.7, seed: int = 0) -> DataFrame:
    """Add ``is_train`` from an arithmetic bucket of a whole-number key; another seed gives another split.

    The same row falls on the same side in every run, also when a task is run again.
    """
    share = F.lit(round(train_share * 1000))
    number = F.col(key) if seed == 0 else hash_key(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    bucket = F.pmod(number % 1000 * SPLIT_FACTOR, F.lit(1000))
    return df.withColumn("is_train", bucket < share)


def train_test_split(
    df: DataFrame, key: str = "row_key", train_share: float = 0.7, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key, train_share, seed)
    return marked.where("is_train").drop("is_train"), marked.where("NOT is_train").drop("is_train")
