import functools
import random

import numpy as np
import xxhash

from basketry.llm import nearcopies
from basketry.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, `NODE` string, `key` string, size int"


def brute_shingles(text):
    words = []
    for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" "):
        if w:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(texts):
    """Smallest index of the group of every text, by all pairs of exact similarity 0.8."""
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b) > 0:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
    texts = [" ".join(base)]
    for _ in range(copies):
        other = list(base)
        for _ in range(edits):
            other[rng.randrange(size)] = f"x{rng.randrange(10_000)}"
        texts.append("\n".join(other))
    return texts


def test_sums_are_plain_sums_of_bytes():
    text = " ".join(f"Wörd{i % 97} {i}" for i in range(700))
    hashes = sorted({xxhash.xxh64_intdigest(s.encode(), 42) for s in brute_shingles(text)})
    assert nearcopies.shingles(text.encode()).tolist() == hashes and len(hashes) > 2 * nearcopies.CHUNK
    full, mix = 1 << 64, 0x9E3779B97F4A7C15
    total = []
    for step in (1, 2, 259):
        lanes = np.zeros(8, int)
        for h in hashes:
            x = h * ((step * mix % full) | 1) % full
            x = (x ^ x >> 32) * mix % full
            x ^= x >> 29
            lanes += np.frombuffer(x.to_bytes(8, "little"), np.uint8)
        total.append(2 * lanes - 255 * len(hashes))
    found = nearcopies.sums(np.array(hashes, np.uint64))
    half = nearcopies.COUNTERS // 2  # even bytes of all numbers, then odd ones
    for step, expected in zip((1, 2, 259), total):
        at = 4 * (step - 1)
        assert found[at : at + 4].tolist() == expected[::2].tolist()
        assert found[half + at : half + at + 4].tolist() == expected[1::2].tolist()


def test_groups_of_near_copies_whatever_the_crowd(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for size, copies, edits in [(300, 40, 2), (120, 30, 1), (500, 3, 6), (60, 2, 1), (8, 1, 0), (3, 2, 0), (200, 0, 0)] * 2:
        texts += family(rng, size, copies, edits)
    texts += [family(rng, 150, 0, 0)[0] for _ in range(60)]
    exact = set(brute_classes(texts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    paired = nearcopies.links
    for heavy in (2, 1000):
        monkeypatch.setattr(nearcopies, "links", functools.partial(paired, heavy=heavy))
        assert {r.doc_id for r in nearcopies.first_near_copies(docs).collect()} == exact


def test_recall_and_estimate_at_the_threshold():
    rng = np.random.default_rng(1)
    shared, own = 160, 20  # similarity 0.8
    met, errors = 0, []
    for _ in range(200):
        hashes = rng.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
        a, b = nearcopies.sums(hashes[: shared + own]), nearcopies.sums(hashes[own:])
        symbols = []
        for x in (a, b):
            groups = x.reshape(-1, nearcopies.SUMS)
            best = np.abs(groups).argmax(axis=1)
            symbols.append(2 * best + (groups[np.arange(len(groups)), best] > 0))
        unlike = (symbols[0] != symbols[1]).reshape(nearcopies.SEGMENTS, nearcopies.SYMBOLS).sum(axis=1)
        met += (unlike <= 1).any()
        cosine = np.cos(np.pi * np.mean((a > 0)[: nearcopies.SIGNS] != (b > 0)[: nearcopies.SIGNS]))
        errors.append(cosine / (2 - cosine) - 0.8)
    assert met >= 170 and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_nulls_ties_repeats_and_empty_tables(spark):
    rng = random.Random(9)
    one, near = family(rng, 80, 1, 1)
    other = family(rng, 80, 0, 0)[0]
    rows = [(5, one), (3, near), (None, one), (3, near), (7, None), (8, ""), (9, " \t"), (None, None), (4, other), (4, "short text")]
    rows += [(None, other + " and more"), (6, "Short text")]
    docs = spark.createDataFrame([(*r, "en", "x", "y", 1) for r in rows], SCHEMA).repartition(3)
    kept = nearcopies.first_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == sorted([(3, near), (4, other), (4, "short text")])
    assert [r.doc_id for r in kept.collect() if not r.text] == [7]
    assert nearcopies.first_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_near_the_threshold_are_settled_exactly(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(10_000)}" for _ in range(204)]  # 200 shingles; a tail of n new words changes n
        tail = rng.choice([20, 21, 22, 23, 24, 26])
        texts += [" ".join(base), " ".join(base[:-tail] + [f"x{rng.randrange(10_000)}" for _ in range(tail)])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in nearcopies.first_near_copies(docs).collect()}
    exact = set(brute_classes(texts))
    assert 30 < len(exact) < 60
    assert exact <= kept and len(kept - exact) <= 0.1 * (60 - len(exact))


def test_no_pair_of_the_similarity_is_left_out(spark, monkeypatch):
    """200 pairs of similarity exactly 0.8: of a SimHash index about one in sixteen was not met at all."""
    rng = random.Random(21)
    texts = []
    for _ in range(200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(94)]  # 90 shingles, 80 of them shared
        texts += [" ".join(base), " ".join(base[:-10] + [f"x{rng.randrange(10**6)}" for _ in range(10)])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in nearcopies.first_near_copies(docs).collect()} == set(range(0, 400, 2))


def test_chains_of_similar_texts_hold_in_a_crowd(spark, monkeypatch):
    """Neighbours in a chain are similar, its ends are not; crowds in blocks of few sets keep every link."""
    rng = random.Random(22)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(words[i * 6 : i * 6 + 90]) for i in range(24)] + [" ".join(f"y{rng.randrange(10**6)}" for _ in range(90))]
    assert set(brute_classes(texts)) == {0, 24}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "links", functools.partial(nearcopies.links, heavy=1))
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    assert {r.doc_id for r in nearcopies.first_near_copies(docs).collect()} == {0, 24}


def test_texts_that_stay_do_not_move(spark):
    """Few rows go, so they are broadcast to the table; crowds of few sets meet as a whole."""
    rng = random.Random(23)
    texts = [t for _ in range(6) for t in family(rng, 80, 3, 1)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = nearcopies.first_near_copies(docs)
    assert {r.doc_id for r in kept.collect()} == set(brute_classes(texts))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    crowds = spark.createDataFrame([(1, n, size) for n, size in ((1, 90), (2, 100), (3, 40))], "crowd long, node long, size long")
    found = spark.createDataFrame([(n, list(range(size))) for n, size in ((1, 90), (2, 100), (3, 40))], "node long, found array<long>")
    met = nearcopies.crowd_links(crowds, found)
    assert [set(r) for r in met.collect()] == [{1, 2}]


def test_texts_that_quote_one_passage_do_not_all_meet(spark, monkeypatch):
    """Quoted shingles that the sample misses go to the end of the order, so pairs do not grow with the square of the quoting texts."""
    rng = random.Random(24)
    monkeypatch.setattr(nearcopies, "SAMPLE", 2)
    held, met = nearcopies.alike, []

    def seen(pairs, *rest):
        met.append(pairs.count())
        return held(pairs, *rest)

    monkeypatch.setattr(nearcopies, "alike", seen)
    passage = " ".join(f"p{i}" for i in range(50))
    for n in (30, 60):
        texts = [f"{family(rng, 70, 0, 0)[0]} {passage}" for _ in range(n)] + family(rng, 90, 12, 1) + family(rng, 90, 1, 1)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert {r.doc_id for r in nearcopies.first_near_copies(docs).collect()} == set(brute_classes(texts))
    assert max(met) <= 13 * 12 // 2 + 1  # those of the families


def test_pairs_of_just_the_similarity_are_linked_in_a_crowd(spark, monkeypatch):
    """Sets of 90 shingles that share 80, and of 396 that share 352: exactly 0.8, which 32-bit products round to less."""
    for size, shared in ((9, 8), (90, 80), (117, 104), (396, 352), (1800, 1600)):
        sets = [np.arange(size), np.arange(size) + (size - shared), np.arange(size) + 10_000]
        a, b = nearcopies._connecting(np.array([5, 6, 7]), sets, 0.8)
        assert list(zip(a.tolist(), b.tolist())) == [(5, 6)], size
    rng = random.Random(25)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]  # 396 shingles, 352 of them shared
        texts += [" ".join(base), " ".join(base[:-44] + [f"x{rng.randrange(10**6)}" for _ in range(44)])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "links", functools.partial(nearcopies.links, heavy=1))
    assert {r.doc_id for r in nearcopies.first_near_copies(docs).collect()} == set(range(0, 80, 2))
