"""Language identification by rank-order profiles.

A profile is the PROFILE most frequent letter n-grams (one to three letters, word ends marked) of a
language or of a document, in order of frequency. The out-of-place distance of two profiles adds up,
over the n-grams of the document, how far their ranks differ; an n-gram that the language does not
have counts as PROFILE places. The nearest language wins.

Profiles are fitted on a bounded sample: about SAMPLE documents per language, chosen by a fixed
hash of the id. Predictions use whole texts.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from basketry.llm.common import arrow_pass, fresh_name, hash_share
from basketry.operators.sizing import small_side

PROFILE = 400
SAMPLE = 4000
MODULUS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Code points of a text looked at together.
CHUNK = 1 << 20

Profiles = list[tuple[str, list[int]]]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point + 1 of every letter, 1 for anything else."""
    table = np.ones(sys.maxunicode + 1, np.int64)
    letters = np.array([c for c in range(sys.maxunicode + 1) if chr(c).isalpha()])
    table[letters] = letters + 1
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text, by rising code; three fields of 21 bits make a code."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = text.lower()
    tail = np.ones(1, np.int64)  # what the next chunk needs of the one before
    for at in range(0, max(1, len(low)), CHUNK):
        points = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "replace"), np.uint32)
        last = at + CHUNK >= len(low)
        row = np.concatenate((tail, _letters()[points], np.ones(1 if last else 0, np.int64)))
        gap = row == 1
        keep = np.ones(len(row), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        row = row[keep]
        seen = len(tail)
        a, b, c = row[:-2], row[1:-1], row[2:]
        one = row[seen:]
        two = ((row[:-1] << 21) | row[1:])[seen - 1 :]
        three = ((a << 42) | (b << 21) | c)[b != 1] if len(row) > 2 else row[:0]
        codes = np.concatenate((one[one != 1], two, three))
        found.append(np.unique(codes, return_counts=True))
        tail = row[-2:]
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([f[1] for f in found]), minlength=len(codes))
    return codes, counts.astype(np.int64)


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes; of equally frequent ones the smaller code comes first."""
    if len(codes) > 8 * size and counts.max() > 1:  # sort only what can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _training_rows(docs: DataFrame, sample: int) -> DataFrame:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(hash_share(F.col("doc_id"), MODULUS) != HELD_OUT)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), F.lit(sample) / F.col("n")).alias("share"))
    chosen = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)) < F.col("share")
    return rows.join(small_side(sizes), F.col("lang") == F.col("_lang")).where(chosen).select("lang", "text")


def learned_profiles(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> Profiles:
    """(language, codes by rank) of every language in the training rows, by language."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, codes, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c, n = grams(text)
            langs.append(np.full(len(c), lang, object))
            codes.append(c)
            counts.append(n)
        if not langs:
            langs, codes, counts = [np.zeros(0, object)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        columns = [
            pa.array(np.concatenate(langs), pa.string()),
            pa.array(np.concatenate(codes), pa.int64()),
            pa.array(np.concatenate(counts), pa.int64()),
        ]
        table = pa.Table.from_arrays(columns, ["lang", "gram", "n"]).group_by(["lang", "gram"]).aggregate([("n", "sum")])
        table = table.select(["lang", "gram", "n_sum"]).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], ["lang", "gram", "n"])

    rows = docs.select("doc_id", "text", "lang")
    counted = arrow_pass(_training_rows(rows, sample), work, "lang string, gram bigint, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "rank", "gram").collect():  # at most ``size`` rows per language
        found.setdefault(r.lang, []).append((r["rank"], r.gram))
    return [(lang, [g for _, g in sorted(found[lang])]) for lang in sorted(found)]


class Ranker:
    """Distances of a document to all profiles."""

    def __init__(self, profiles: Profiles, size: int = PROFILE):
        self.langs = [lang for lang, _ in profiles]
        self.size = size
        self.known = np.unique(np.array([g for _, codes in profiles for g in codes], np.int64))
        # one more column stands for an n-gram that no language has
        self.ranks = np.full((len(profiles), len(self.known) + 1), -1, np.int64)
        for row, (_, codes) in enumerate(profiles):
            self.ranks[row, np.searchsorted(self.known, np.array(codes, np.int64))] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not self.langs or not len(codes) or codes[0] >> 21 or codes[0] == 1:
            return UNKNOWN, 0.0
        mine = profile(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.known, mine), len(self.known) - 1)
        at = np.where(self.known[at] == mine, at, len(self.known))
        theirs = self.ranks[:, at]
        away = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(mine)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(mine)))


def predicted(
    docs: DataFrame, profiles: Profiles, size: int = PROFILE, keep: tuple = ("doc_id",), names: tuple = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` per row of ``docs``.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. The score is 1 for a
    document in the exact order of its language's profile and 0 if no n-gram is shared; of equally near
    languages the first by name wins. Repeated rows are predicted alike; other columns are not read.
    """
    slim = docs.select(*keep, F.col("text").alias(fresh_name(docs, "_text")))
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    holder: dict[str, Ranker] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "r" not in holder:
            holder["r"] = Ranker(profiles, size)
        found = [holder["r"].predict(t) for t in batch.column(len(keep)).to_pylist()]
        columns = [batch.column(i) for i in range(len(keep))]
        columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*keep, *names])

    return arrow_pass(slim, work, f"{kinds}, {names[0]} string, {names[1]} double")


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, profiles learned from the rows that are not held out."""
    found = predicted(docs, learned_profiles(docs, sample))
    held_out = hash_share(F.col("doc_id"), MODULUS) == HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` in which a language is found, in all their columns."""
    names = docs.columns
    pred, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "score")
    found = predicted(docs, learned_profiles(docs, sample), keep=tuple(names), names=(pred, score))
    return found.where(F.col(pred) != UNKNOWN).select(*names)
