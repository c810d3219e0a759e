"""Size checks before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basketry.session import cut_lineage

MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 16 << 20
ROWS_PER_TASK = 10_000
# Rows of a part that is held in memory and read in every round of a fit: some 70 MB of vectors.
ROWS_PER_PART = 250_000
# A dimension of this many narrow rows takes about 150 MB of an executor as a hash table.
DIMENSION_ROWS = 2_000_000
DIMENSION_BYTES = 128 << 20


def dimension(df: DataFrame) -> DataFrame:
    """A table with a row per key, marked for broadcast if it has at most DIMENSION_ROWS rows and DIMENSION_BYTES.

    Its rows are counted now, the columns of text with their lengths; nothing is held. Hand in only the columns
    that are wanted. A larger one comes back as it is and is joined by shuffle.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    size = sum(texts, F.lit(16 * len(df.columns))).cast("bigint")
    held = df.select(size.alias("_size")).limit(DIMENSION_ROWS + 1).agg(F.count(F.lit(1)), F.sum("_size")).first()
    return F.broadcast(df) if held[0] <= DIMENSION_ROWS and (held[1] or 0) <= DIMENSION_BYTES else df


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame as the small side of a join.

    Reads at most ``max_rows`` + 1 rows. If that is all of them and they fit MAX_BROADCAST_BYTES, they become
    a local relation that is broadcast. A larger frame is checkpointed and joined by shuffle.
    """
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    # what the probe has computed is not computed again
    held = df.persist() if own else df
    try:
        rows = held.limit(max_rows + 1).toArrow()
        if rows.num_rows <= max_rows and rows.nbytes <= MAX_BROADCAST_BYTES:
            return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
        return cut_lineage(held)
    finally:
        if own:
            held.unpersist()


def for_iterations(df: DataFrame) -> DataFrame:
    """Fewer partitions for a frame an iterative fit reads many times, if its rows are few.

    Partitions are only merged, never below the parallelism that the number of rows can use.
    """
    return df.coalesce(max(1, -(-df.count() // ROWS_PER_TASK)))


def in_parts(df: DataFrame, rows: int = ROWS_PER_PART) -> DataFrame:
    """A checkpointed or written frame in more partitions, if they have more than ``rows`` rows on average.

    Files and joins give partitions of so many bytes; what a task then holds of narrow rows is many times that.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df
