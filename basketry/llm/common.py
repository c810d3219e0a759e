"""Helpers shared by the text operators: words, parts in key order, row keys, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketry.operators.ordered import cut_points, with_bucket
from basketry.session import cut_lineage, scratch_path

__all__ = ["words", "settled", "ordered_parts", "arrow_pass", "text_bytes", "hash_share", "cut_lineage", "scratch_path", "fresh_name"]

# White space that ends a word: the space and the five ASCII controls from tab to carriage return.
SPACES = "\t\n\x0b\x0c\r"

# Parts of a key order. Each part is read as a stream, so a part may be larger than memory.
ROWS_PER_PART = 4096
MAX_PARTS = 20_000


def spaced(text: Column) -> Column:
    """The text with every white space character as a plain space and none at the ends; null is empty."""
    return F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))


def words(text: Column) -> Column:
    """Words of a text, ``[^\\x20\\x09-\\x0D]+``, in order; an empty array if there are none."""
    plain = spaced(text)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def text_bytes(text: Column) -> Column:
    """UTF-8 of a text for an Arrow pass; null is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def hash_share(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_pass(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, at_once: int | None = None
) -> DataFrame:
    """One record batch in, one out, streamed; nothing is kept between batches.

    With ``at_once`` a larger batch is handed to ``work`` in parts of about that many bytes, whatever the length of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows if not at_once else max(1, batch.num_rows * at_once // max(1, batch.nbytes))
            for at in range(0, max(1, batch.num_rows), max(1, rows)):
                yield work(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def settled(df: DataFrame, long_rows: bool = False) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: lineage is cut, lost executors cost nothing.

    With ``long_rows`` a page ends at its bytes after any row; else it has 100 rows at least, whatever their length.
    """
    path = scratch_path(df.sparkSession, "tables", uuid.uuid4().hex)
    pages = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"} if long_rows else {}
    df.write.options(**pages).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_parts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``, a part number that rises with the long column ``key``; rows with equal keys share a
    part and nulls come first. Parts hold about ROWS_PER_PART rows, and there are at most MAX_PARTS."""
    number = fresh_name(df, "_number")
    keyed = df.withColumn(number, F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))))
    ids = keyed.select(number)
    parts = max(1, min(MAX_PARTS, ids.count() // ROWS_PER_PART))
    cuts = cut_points(ids.where(F.col(number) > float("-inf")), number, parts) if parts > 1 else []
    return with_bucket(keyed, number, cuts, name).drop(number)
