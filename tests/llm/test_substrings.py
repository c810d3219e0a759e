from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import recompression, substrings


def plain(rows, span):
    """Kept words per row, window by window."""
    key = lambda r: r[0] if r[0] is not None else 1 << 63
    words = [(r[1] or "").encode().split() for r in rows]
    first = {}
    for r, w in zip(rows, words):
        for p in range(len(w) - span + 1):
            k = tuple(w[p : p + span])
            first[k] = min(first.get(k, 1 << 64), key(r))
    out = []
    for r, w in zip(rows, words):
        gone = set()
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] < key(r):
                gone.update(range(p, p + span))
        out.append((r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def check(rows, frame, span, rounds):
    found = substrings.deduplicated(frame, span=span, rounds=rounds)
    assert found.columns[: len(frame.columns)] == frame.columns
    joined = F.array_join(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\n\t", "  "), " "), lambda x: x != ""), " ")
    got = [(r.doc_id, r.n_words, r.n_removed, r.t) for r in found.select("*", joined.alias("t")).collect()]
    assert Counter(got) == Counter(plain(rows, span))
    unchanged = {(r.doc_id, r.text) for r in found.where("n_removed = 0").collect()}
    assert unchanged <= {(r[0], r[1]) for r in rows}


def test_matches_windows_one_by_one(documents):
    rows, frame = documents
    check(rows, frame, 50, recompression.ROUNDS)
    check(rows, frame, 7, 3)


def test_empty_table(no_documents):
    assert substrings.deduplicated(no_documents).count() == 0


def test_equal_windows_take_equal_anchors():
    rng = np.random.default_rng(4)
    core = rng.integers(0, 5, 50).astype(np.uint64)
    seen = set()
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 9)), rng.integers(0, 5, rng.integers(0, 9))
        row = np.concatenate((a, core, b)).astype(np.uint64)
        groups = recompression.anchors(row, np.zeros(len(row), np.int64))
        at = len(a)
        g = np.flatnonzero((groups.first <= at) & (at <= groups.last))
        assert len(g) == 1
        seen.add((int(groups.name[g[0]]), int(groups.level[g[0]])))
    assert len(seen) == 1


def test_every_window_is_in_one_group():
    rng = np.random.default_rng(1)
    text = np.sort(rng.integers(0, 6, 900))
    name = rng.integers(0, 3, 900).astype(np.uint64)
    groups = recompression.anchors(name, text)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(groups.first, groups.last)])
    assert (np.sort(starts) == np.flatnonzero(text[:851] == text[49:])).all()


def test_many_rows_without_an_id(spark):
    """Rows that share an id, or have none, are told apart by 128 bits of their texts."""
    import random

    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(20)] for _ in range(6)]
    rows = []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 60]))]
        if i % 3 == 0:
            words[len(words) // 2 : 0] = rng.choice(passages)
        rows.append((i if i % 4 == 0 else None if i % 4 == 1 else 7, " ".join(words)))
    check(rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6), 9, 3)


def test_starts_of_another_text_are_not_followed(spark, monkeypatch):
    """Were the marks of two texts the same, the shorter one would still come out whole."""
    monkeypatch.setattr(
        substrings, "_mark", lambda text: F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"))
    )
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (None, "x y z " + long), (None, "a short text")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.text for r in substrings.deduplicated(frame, span=9, rounds=3).collect()}
    assert "a short text" in found
