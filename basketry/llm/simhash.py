"""Near-duplicates by SimHash fingerprints of 64 bits, linked where at most two bits differ.

Candidates come from deletion-variant signatures. A fingerprint is cut into two segments of 32 bits;
of two differing bits at most one lies in one of the segments, so two linked fingerprints share
that segment with one bit left open. Every distinct fingerprint is indexed under its 64 variants
(segment, open bit, the other 31 bits), equal variants are joined, and pairs are verified by
counting bits.

Copies never meet: the index holds each fingerprint once. A variant shared by more than
HEAVY fingerprints is not paired. Its members are indexed again with open bits in the other segment
so that all members of one second variant (four at most) are within two bits of each other; the
first of them is linked to the rest. That is linear in the group and loses no link.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import arrow_pass, cut_lineage, fresh_name, text_bytes
from basketry.llm.components import connected_components
from basketry.operators.sizing import dimension

SEED = 42
SHINGLE = 3
MAX_BITS = 2
# Members up to which a variant is joined in pairs; above it the second index takes over (same links).
HEAVY = 256
# Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    found = text.lower().split()  # bytes: lower-cases A-Z only and splits at ASCII white space only
    if not found:
        return 0
    if len(found) < size:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(size)))))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        hashes = b"".join([digest(s, SEED) for s in shingles[at : at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row of ``docs``; a null or wordless text has fingerprint zero."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(F.col(text)).alias("text"))
    return arrow_pass(slim, work, f"doc_id {kind}, fp bigint")


def _bits_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): 64 rows per fingerprint, one for each segment and open bit."""
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select(
        F.expr(
            "(shiftrightunsigned(fp, 32 * (k div 32)) & 4294967295L & ~shiftleft(1L, cast(k % 32 as int)))"
            " | shiftleft(cast(k as bigint), 32)"
        ).alias("key"),
        "fp",
    )


def links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of ``prints`` (column fp, no repeats) that connect
    exactly what all pairs within two bits connect."""
    index = variants(prints)
    shared = cut_lineage(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut_lineage(index.join(shared, "key"))
    light = members.where(F.col("n") <= heavy)
    pairs = (
        light.select("key", F.col("fp").alias("a"))
        .join(light.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (_bits_apart("a", "b") <= MAX_BITS))
        .select("a", "b")
    )
    return pairs.union(_second_index(members.where(F.col("n") > heavy))).distinct()


def _second_index(members: DataFrame) -> DataFrame:
    """Links inside crowded variants. Either the open bit differs and one bit of the other segment may,
    or the segment is equal and two bits of the other may."""
    segment = F.expr("cast(shiftrightunsigned(key, 37) as int)")
    other = F.expr("shiftrightunsigned(fp, 32 * (1 - segment)) & 4294967295L")
    own = F.expr("shiftrightunsigned(fp, 32 * segment) & 4294967295L")
    rows = members.withColumn("segment", segment).withColumns({"other": other, "own": own})
    one = rows.select(
        "fp", "key", F.explode(F.expr("transform(sequence(0, 31), i -> struct(i, -1 as j))")).alias("o"), "other"
    )
    two = (
        rows.select("fp", F.expr("own | shiftleft(cast(64 + segment as bigint), 32)").alias("key"), "other")
        .distinct()
        .select(
            "fp",
            "key",
            F.explode(
                F.expr("flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1), j -> struct(i, j))))")
            ).alias("o"),
            "other",
        )
    )
    opened = one.union(two).select(
        "fp",
        "key",
        (F.col("o.i") * 64 + F.col("o.j")).alias("open"),
        F.expr("other & ~shiftleft(1L, o.i) & ~(if(o.j < 0, 0L, shiftleft(1L, greatest(o.j, 0))))").alias("rest"),
    )
    group = Window.partitionBy("key", "open", "rest")  # at most four members: two bits are open
    return opened.select(F.min("fp").over(group).alias("a"), F.col("fp").alias("b")).where("a != b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest id among the rows
    reachable over links, so a row without a link has its own id.

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows share a
    component. Null ids are never the smallest; a component of null ids only has a null component_id.
    Other columns are not read; an empty table gives an empty table.
    """
    prints = cut_lineage(with_fingerprints(docs, doc_id, text))
    rooted = _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(rooted.join(smallest, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame) -> DataFrame:
    """(fp, first, root) per row of ``distinct`` (fp, first), one row per fingerprint; the root names the component."""
    distinct = cut_lineage(distinct)
    found = cut_lineage(connected_components(links(distinct.select("fp"))))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    return cut_lineage(rooted)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) per row and (fp, first, root) per fingerprint of ``rows`` (row, text)."""
    prints = cut_lineage(with_fingerprints(rows, "row", "text"))
    return prints, _rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))


def first_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    grouped: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = _grouped,
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when one row of each component does: that with the smallest
    id, and of rows that share this id the first by the hash of the text. Null ids come last.

    Ids choose inside a component only, so rows without an id or with a repeated one stay if their texts are unrelated.
    ``grouped`` finds the components.
    """
    a, b = fresh_name(docs, "_mark_a"), fresh_name(docs, "_mark_b")
    # 128 bits that stand for the whole row; maps and variants cannot be hashed
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    absent = [c.isNull().cast("int") for c in plain]  # a null leaves a hash as it is
    marked = docs.withColumns({a: F.xxhash64(*plain, *absent), b: F.xxhash64(F.lit(SEED), *absent, *plain)})
    order = F.struct(
        F.col(doc_id).isNull().alias("absent"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("of_text"),
        F.col(a).alias("a"), F.col(b).alias("b"),
    )
    slim = marked.select(order.alias("row"), F.col(text).alias("text"))
    prints, rooted = grouped(slim)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.a").alias(a), F.col("first.b").alias(b))
    kept = cut_lineage(kept)
    repeated = prints.groupBy(F.col("doc_id.a").alias(a), F.col("doc_id.b").alias(b)).agg(F.count("*").alias("n"))
    repeated = cut_lineage(repeated.where("n > 1").select(a, b))
    # the rows that go are fewer than those that stay; as a broadcast they move no text
    every = prints.select(F.col("doc_id.a").alias(a), F.col("doc_id.b").alias(b)).distinct()
    gone = every.join(kept, [a, b], "left_anti")
    if repeated.isEmpty():
        return marked.join(dimension(cut_lineage(gone)), [a, b], "left_anti").drop(a, b)
    # rows that are the same in every column: one of them, combined before the exchange
    single = marked.join(dimension(cut_lineage(gone.union(repeated))), [a, b], "left_anti")
    several = marked.join(dimension(cut_lineage(kept.join(repeated, [a, b], "left_semi"))), [a, b], "left_semi").dropDuplicates([a, b])
    return single.union(several).drop(a, b)
