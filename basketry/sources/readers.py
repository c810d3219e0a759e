"""CSV ingest and the table catalogue."""

from __future__ import annotations

from fnmatch import fnmatchcase
from typing import Iterable, Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.sources.inference import inferred_types
from basketry.sources.schemas import CATALOG, NULL_TOKENS, REAL, TableSpec


def _typed(name: str, kind: str, null_tokens: Iterable[str]) -> Column:
    text = F.when(~F.col(name).isin(*null_tokens), F.col(name))
    if kind == "int":
        # whole numbers are sometimes exported as 58.0
        number = text.cast("double")
        whole = F.when(number == F.floor(number), number.cast("int"))
        broken = F.raise_error(F.concat(F.lit(f"{name} is not a whole number: "), text)).cast("int")
        return F.when(number.isNotNull(), F.coalesce(whole, broken)).alias(name)
    if kind == REAL:
        # NaN counts as greater than everything in comparisons, so it becomes null at the door
        number = text.cast("double")
        return F.when(~F.isnan(number), number).alias(name)
    return text.cast(kind).alias(name)


def rename_columns_if_present(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})


def read_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    renames: Mapping[str, str] | None = None,
    free_text: bool = False,
    null_tokens: Iterable[str] = NULL_TOKENS,
    infer: bool = False,
) -> DataFrame:
    """Headered CSV to typed columns.

    Columns are matched by header name, not by position. A value that does not parse as its
    declared type raises under ANSI mode, as the reports must not silently lose rows. Columns without a declared
    type stay text, or with ``infer`` get the narrowest type that fits all their values, at one more pass over the file.
    """
    raw = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=free_text, quote='"', escape='"'
    )
    raw = rename_columns_if_present(raw, renames or {})
    types = types or {}
    tokens = tuple(null_tokens)
    if infer:
        open_columns = [c for c in raw.columns if c not in types]
        types = inferred_types(raw.select(*(F.col(f"`{c}`") for c in open_columns)), tokens) | types
    return raw.select(*(_typed(c, types.get(c, "string"), tokens) for c in raw.columns))


def matched_names(df: DataFrame, pattern: str) -> set[str]:
    """Names of the files or folders of a frame's input that match a pattern."""
    parts = (part for file in df.inputFiles() for part in unquote(file).split("/"))
    return {part for part in parts if fnmatchcase(part, pattern)}


def read_table(spark: SparkSession, base_path: str, spec: TableSpec, infer: bool = False) -> DataFrame:
    """One table of the catalogue; more than one file or folder for its pattern raises. With ``infer`` its
    types come from its values instead of the declaration."""
    found = matched_names(spark.read.format("binaryFile").load(f"{base_path}/{spec.file}"), spec.file)
    if len(found) > 1:
        raise ValueError(f"{spec.name}: several exports match {spec.file}: {sorted(found)}")
    types = {} if infer else spec.types
    return read_csv(spark, f"{base_path}/{spec.file}", types, spec.renames, spec.free_text, infer=infer)


def load_catalog(
    spark: SparkSession, base_path: str, specs: Iterable[TableSpec] = CATALOG
) -> dict[str, DataFrame]:
    """Read every table of the catalogue and register each as a temp view."""
    tables = {spec.name: read_table(spark, base_path, spec) for spec in specs}
    register_views(tables)
    return tables


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def sql_scan(spark: SparkSession, text: str) -> DataFrame:
    """SQL text over the registered views to a lazy frame."""
    return spark.sql(text)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its number of rows."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    result = counted[0]
    for other in counted[1:]:
        result = result.unionByName(other)
    return result


def table_schema(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Position, name, type and number of filled values of every column, in one pass over the frame."""
    types = dict(df.dtypes)
    names = list(columns or df.columns)
    counts = df.agg(*(F.count(F.col(c)).alias(c) for c in names))
    entries = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(types[c]).alias("type"),
                F.col(c).alias("filled"),
            )
            for i, c in enumerate(names, start=1)
        )
    )
    return counts.select(F.inline(entries))


def view_schema(tables: Mapping[str, DataFrame], columns: Iterable[str]) -> DataFrame:
    """The schema of a view over several tables from the tables themselves, without joining them.

    Each column is looked up in the first table that has it; ``filled`` counts the rows of that table.
    """
    names = list(columns)
    owner = {c: next((t for t, df in tables.items() if c in df.columns), None) for c in names}
    parts = []
    for table, df in tables.items():
        own = [c for c in names if owner[c] == table]
        if own:
            positions = F.create_map(*(x for c in own for x in (F.lit(c), F.lit(names.index(c) + 1))))
            schema = table_schema(df, own).withColumn("position", positions[F.col("column_name")])
            parts.append(schema.select("position", "column_name", F.lit(table).alias("table_name"), "type", "filled"))
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result
