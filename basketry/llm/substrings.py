"""Removal of long word sequences that an earlier document has, found by recompression.

A window is SPAN consecutive words. A word goes if it is covered by a window whose word sequence also starts
in a document with a smaller id. Windows are judged on the input.

1. Every text is parsed by recompression (see ``recompression``). Names are hashes of content, so all
   tasks name equal runs and pairs alike. Each window takes one interior symbol, its anchor; consecutive
   windows with the same one are a group, about one per twenty words.
2. A Spark round over the names finds symbols that occur in more than one document. Windows of other
   symbols occur once and are done.
3. Groups of a shared symbol are compared by their context, the words from the first to the last of
   their windows. If an earlier document has the same symbol in the same context, all windows of the
   group are repeated. That settles the inside of long passages and whole copies with one row per group.
4. What is left are first occurrences of contexts that share a symbol with another context, mostly at
   the ends of passages. Only their windows are compared one by one, by name and window hash together
   (128 bits).

Rows are aggregated before they are shuffled by name, nothing is paired within a group, and a symbol
shared by any number of documents costs one row per group.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.llm.common import arrow_pass, fresh_name, settled, text_bytes
from basketry.llm.recompression import ROUNDS, SPAN, Anchors, Sums, anchors
from basketry.llm.toxicity import slices
from basketry.llm.wordhash import Words, mixed_bits, words_of

_LAST = (1 << 63) - 1
# Bytes of rows that a worker has as objects at a time.
AT_ONCE = 4 << 20


def _parsed(texts: list[bytes], span: int, rounds: int) -> tuple[Words, Anchors, np.ndarray, np.ndarray, Sums]:
    """(words, groups, place of each group in its text, first word of each text, stretch hashes)."""
    words = words_of(texts)
    groups = anchors(words.hash, words.text, span, rounds)
    sums = Sums(words.hash)
    alone = groups.level < 0
    whole = mixed_bits(sums.between(groups.first, groups.first + span) ^ np.uint64(0x5851F42D4C957F2D))
    groups.name = np.where(alone, whole, groups.name)
    per_text = np.bincount(groups.text, minlength=len(texts))
    place = np.arange(len(groups.text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    base = np.cumsum(words.count) - words.count
    return words, groups, place, base, sums


# 128 bits of the text: rows that share an id, or have none, are as many as a table may hold.
MARK = "struct<a:bigint,b:bigint>"


def _mark(text: str) -> Column:
    """Tells rows with the same id apart by their texts."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), F.reverse(text)).alias("b"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def group_rows(keyed: DataFrame, span: int, rounds: int) -> DataFrame:
    """(at, mark, place, name, context) per group of windows; ``keyed`` has at, mark and text as bytes."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        owner, place, name, context = [], [], [], []
        for rows in slices(texts):
            _, groups, at, _, sums = _parsed(texts[rows], span, rounds)
            size = (groups.last - groups.first).astype(np.uint64)
            owner.append(groups.text + rows.start)
            place.append(at)
            name.append(groups.name.astype(np.uint64))
            context.append(mixed_bits(sums.between(groups.first, groups.last + span) + size))
        none = np.zeros(0, np.int64)
        take = pa.array(np.concatenate(owner or [none]))
        columns = [
            batch.column(0).take(take),
            batch.column(1).take(take),
            pa.array(np.concatenate(place or [none]).astype(np.int32)),
            _signed(np.concatenate(name or [none])),
            _signed(np.concatenate(context or [none])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["at", "mark", "place", "name", "context"])

    return arrow_pass(keyed, work, f"at bigint, mark {MARK}, place int, name bigint, context bigint", AT_ONCE)


def _window_rows(opened: DataFrame, span: int, rounds: int) -> DataFrame:
    """(at, mark, start, name, hash) per window of the groups listed in ``open``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        owner, start, name, hashed = [], [], [], []
        for rows in slices(texts):
            _, groups, place, base, sums = _parsed(texts[rows], span, rounds)
            found = _listed(groups, place, lists[rows])
            size = groups.last[found] - groups.first[found] + 1
            ends = np.cumsum(size)
            at = np.repeat(groups.first[found] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            text = np.repeat(groups.text[found], size)
            owner.append(text + rows.start)
            start.append(at - base[text])
            name.append(np.repeat(groups.name[found], size).astype(np.uint64))
            hashed.append(mixed_bits(sums.between(at, at + span)))
        none = np.zeros(0, np.int64)
        take = pa.array(np.concatenate(owner or [none]))
        columns = [
            batch.column(0).take(take),
            batch.column(1).take(take),
            pa.array(np.concatenate(start or [none]).astype(np.int32)),
            _signed(np.concatenate(name or [none])),
            _signed(np.concatenate(hashed or [none])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["at", "mark", "start", "name", "hash"])

    return arrow_pass(opened, work, f"at bigint, mark {MARK}, start int, name bigint, hash bigint", AT_ONCE)


def _listed(groups: Anchors, place: np.ndarray, lists: list) -> np.ndarray:
    """Numbers of the groups whose place is in the list of their text."""
    if not len(place):
        return np.zeros(0, np.int64)
    wide = int(place.max()) + 1
    wanted = [np.array(x, np.int64) + i * wide for i, x in enumerate(lists) if x]
    if not wanted:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.isin(groups.text * wide + place, np.concatenate(wanted)))


def repeated(docs: DataFrame, doc_id: str, text: str, span: int = SPAN, rounds: int = ROUNDS) -> DataFrame:
    """(at, mark, done, starts): per id and text, the groups and the single windows that an earlier document has."""
    at = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)).alias("at")
    mark = _mark(text).alias("mark")
    keyed = docs.select(at, mark, text_bytes(F.col(text)).alias("text"))
    rows = group_rows(keyed, span, rounds)
    shared = rows.groupBy("name").agg(
        F.min("at").alias("low"), F.max("at").alias("top"), F.min("context").alias("c1"), F.max("context").alias("c2")
    )
    shared = settled(shared.where("low < top").select("name", (F.col("c1") != F.col("c2")).alias("several")))
    hits = settled(rows.join(shared, "name"))
    firsts = settled(hits.groupBy("name", "context").agg(F.min("at").alias("first")))
    judged = hits.join(firsts, ["name", "context"]).select(
        "at",
        "mark",
        F.when(F.col("first") < F.col("at"), F.col("place")).alias("done"),
        F.when((F.col("first") == F.col("at")) & F.col("several"), F.col("place")).alias("open"),
    )
    # lists per text, no longer than the text has windows
    groups = settled(
        judged.where("done is not null or open is not null")
        .groupBy("at", "mark")
        .agg(F.collect_set("done").alias("done"), F.collect_set("open").alias("open"))
    )
    opened = keyed.join(groups.where(F.size("open") > 0).select("at", "mark", "open"), ["at", "mark"])
    windows = settled(_window_rows(opened.select("at", "mark", "text", "open"), span, rounds))
    again = windows.groupBy("name", "hash").agg(F.min("at").alias("first"), F.max("at").alias("top"))
    again = settled(again.where("first < top").select("name", "hash", "first"))
    single = windows.join(again, ["name", "hash"]).where("first < at")
    single = settled(single.groupBy("at", "mark").agg(F.collect_set("start").alias("starts")))
    verdicts = groups.where(F.size("done") > 0).select("at", "mark", "done").join(single, ["at", "mark"], "full")
    return settled(verdicts)


def deduplicated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, rounds: int = ROUNDS
) -> DataFrame:
    """``docs`` in all columns, the text without repeated words, and ``n_words`` and ``n_removed`` (under fresh names).

    A text that loses words is what is kept, joined by single spaces; others are unchanged, also if null or empty.
    Rows with the same id never count as earlier than each other, be they equal or not. Null ids count as
    one id after all others. An empty table gives an empty table.
    """
    verdicts = repeated(docs, doc_id, text, span, rounds)
    names = docs.columns
    counts = [fresh_name(docs, "n_words"), fresh_name(docs, "n_removed")]
    a, m, d, s = (fresh_name(docs, n) for n in ("_at", "_mark", "_done", "_starts"))
    verdicts = verdicts.select(F.col("at").alias(a), F.col("mark").alias(m), F.col("done").alias(d), F.col("starts").alias(s))
    keyed = docs.withColumns(
        {a: F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST)), m: _mark(text)}
    )
    joined = keyed.join(verdicts, [a, m], "left").select(*names, d, s)
    where = names.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = len(names)
        texts, done, starts = (batch.column(i).to_pylist() for i in (where, k, k + 1))
        n_words, n_removed = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = (t or "").encode().split()
            n_words[i] = len(found)
            if not done[i] and not starts[i]:
                continue
            delta = np.zeros(len(found) + 1, np.int64)
            if done[i]:
                _, groups, place, _, _ = _parsed([t.encode()], span, rounds)
                take = np.isin(place, done[i])
                np.add.at(delta, groups.first[take], 1)
                np.add.at(delta, groups.last[take] + span, -1)
            if starts[i]:
                at = np.array(starts[i])
                at = at[at + span <= len(found)]  # no start of another text, whatever the marks say
                np.add.at(delta, at, 1)
                np.add.at(delta, at + span, -1)
            gone = np.cumsum(delta[:-1]) > 0
            n_removed[i] = int(gone.sum())
            texts[i] = b" ".join(itertools.compress(found, ~gone)).decode()
        columns = [batch.column(i) for i in range(k)]
        columns[where] = pa.array(texts, batch.schema.field(where).type)
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(n_words), pa.array(n_removed)], [*names, *counts]
        )

    schema = StructType([*docs.schema.fields, StructField(counts[0], LongType()), StructField(counts[1], LongType())])
    return arrow_pass(joined, work, schema, AT_ONCE)


