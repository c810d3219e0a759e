import random

import xxhash

from basketry.llm import simhash
from basketry.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, FP string, `key` string"


def brute_fingerprint(text):
    words = []
    for w in (text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" "):
        if w:
            words.append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    ids = list(range(len(items)))

    def find(x):
        while ids[x] != x:
            x = ids[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i] ^ items[j]).count("1") <= 2:
                ids[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(items))]


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"Wörd{i}" for i in range(40)] + ["A", "b", "ÀB"]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            near = list(base)
            if near:
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("\n".join(near))
    texts += [None, "", " \t\x0b\x0c\r\n", "x\xa0y z", texts[4], texts[4]]
    rows = [(1000 - i, t, None, "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[r[0]].fp & (1 << 64) - 1 for r in rows] == prints
    roots = brute_components(prints)
    smallest = {root: min(r[0] for r, x in zip(rows, roots) if x == root) for root in roots}
    assert [got[r[0]].component_id for r in rows] == [smallest[x] for x in roots]


def test_crowded_variants_give_the_same_components(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = set()
    for c in centres:
        for _ in range(60):
            p = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 5])):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    truth = {}
    for p, r in zip(signed, brute_components(prints)):
        truth.setdefault(r, set()).add(p)
    truth = {frozenset(v) for v in truth.values() if len(v) > 1}
    for heavy in (1, 3, 1000):
        groups = {}
        for r in connected_components(simhash.links(frame, heavy)).collect():
            groups.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in groups.values()} == truth


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, "same text here now", "en", None, None), (None, "same text here now", "en", None, None),
            (7, "a b c d", None, None, None), (7, "a b c d", "en", None, None), (None, "a b c d", "en", None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(frame).collect())
    assert got == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None"), ("None", "None")]
    kept = simhash.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["7", "None"]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_each(empty).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one_stay(spark):
    def text(seed):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(500)}" for _ in range(60))

    rows = [(None, text(i), "en", None, None) for i in range(20)]  # unrelated, no id
    rows += [(5, text(i), "en", None, None) for i in range(30, 34)]  # unrelated, one id
    rows += [(1, text(33), "en", None, None), (None, text(32), None, "b", None)]  # a smaller id, a copy without one
    rows += [(None, text(40), None, None, "z")] * 3 + [(6, text(41), x, None, None) for x in ("de", None, "en")]
    got = simhash.first_of_each(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    expected = {(None, text(i)) for i in (*range(20), 40)} | {(5, text(i)) for i in (30, 31, 32)} | {(1, text(33)), (6, text(41))}
    assert {(r.doc_id, r.text) for r in got} == expected and len(got) == len(expected)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (3, 2)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}


def test_rounds_of_components_do_not_raise_the_estimated_size(spark):
    """The size of a join is estimated as a product; kept over the rounds, its digits grew fourfold with each one."""
    path = random.Random(6).sample(range(200), 200)
    found = connected_components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long").repartition(4))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(200)}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**200
