"""Table and report sinks. Every write replaces the previous output.

A write goes to a folder beside the table, hidden from readers of the parent, and takes the table's place by renaming
when it is whole. A write that fails leaves the old rows as they were, and a frame may be written over the table
that it reads.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import Iterator, Mapping

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# Imports that run side by side; the files of a small table do not fill a cluster.
SIDE_BY_SIDE = 4


@contextmanager
def _in_place_of(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write to; it becomes ``path`` if the block ends well and goes if it does not."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    staged, old = (hadoop(target.getParent(), f"_{target.getName()}.{mark}.{kind}") for kind in ("new", "old"))
    try:
        yield staged.toString()
        held = system.exists(target)
        if held and not system.rename(target, old):
            raise OSError(f"{path} cannot be replaced")
        if not system.rename(staged, target):
            if held:
                system.rename(old, target)
            raise OSError(f"{path} cannot be replaced")
        if held:
            system.delete(old, True)
    finally:
        if system.exists(staged):
            system.delete(staged, True)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write a table, replacing an older one, and read it back."""
    with _in_place_of(df.sparkSession, path) as folder:
        df.write.format(fmt).save(folder)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def import_table(df: DataFrame, path: str) -> int:
    """Replace a table and return the rows written, counted while they are written."""
    seen = Observation()
    with _in_place_of(df.sparkSession, path) as folder:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    return seen.get["rows"]


def import_tables(tables: Mapping[str, DataFrame], base_path: str) -> DataFrame:
    """Replace every table below ``base_path``; one row with the imported rows per table."""
    spark = next(iter(tables.values())).sparkSession

    def one(name: str) -> tuple[str, int]:
        return name, import_table(tables[name], f"{base_path}/{name}")

    with ThreadPool(min(SIDE_BY_SIDE, len(tables))) as pool:
        counts = pool.map(inheritable_thread_target(spark)(one), tables)
    return spark.createDataFrame(counts, "table_name string, row_count bigint")


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist one report as parquet, csv or json in its own folder."""
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    with _in_place_of(df.sparkSession, path) as folder:
        writer.save(folder)


def write_reports(reports: Mapping[str, DataFrame], base_path: str, fmt: str = "parquet") -> None:
    for name, df in reports.items():
        write_report(df, f"{base_path}/{name}", fmt)
