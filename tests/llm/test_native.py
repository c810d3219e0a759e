"""Mixing, packing and rules: built-in functions only, compared with SQL or brute force."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from basketry.llm import mixing, packing, rules


def same_as_sql(frame, documents, sql):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    other = con.sql(sql)
    names = sorted(frame.columns)
    assert names == sorted(other.columns)
    key = lambda r: tuple(map(repr, r))
    mine = sorted((tuple(r[c] for c in names) for r in frame.collect()), key=key)
    theirs = sorted(other.select(", ".join(f'"{c}"' for c in names)).fetchall(), key=key)
    assert mine == theirs


def test_mix_matches_sql_and_its_targets(documents):
    rows, frame = documents
    mix = mixing.mixed(frame)
    same_as_sql(mix.select("doc_id", "size", "source_size", "target", "taken"), frame, mixing.sql())
    got = mix.collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size and r.taken % max(1, r["size"]) == 0 for r in got)
    total = sum(len((r[1] or "").encode().split()) for r in rows)
    per = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in per.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * s + 1e-9 for t, s in per.values())
    again = Counter(map(tuple, mixing.mixed(frame.repartition(3)).collect()))
    assert again == Counter(map(tuple, got))


def test_targets_reshare_until_none_is_above(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 700, "": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.remove(s)
    assert all(abs(got[s] - target[s]) < 1e-6 for s in order)


def test_draws_come_near_and_weights_matter(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([5, 50, 500])), f"s{i % 3}") for i in range(900)]
    rows += [(10_000 + i, "w *** $$$ " * 20, "s0") for i in range(300)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    taken, target, hits = defaultdict(int), {}, defaultdict(list)
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        if r.source == "s0":
            hits[r.doc_id >= 10_000].append(r.taken / r["size"])
    assert all(abs(taken[s] / target[s] - 1) < 0.01 for s in target)
    mean = lambda x: sum(x) / len(x)
    assert mean(hits[False]) >= mean(hits[True])


def test_mixed_rows_repeat_as_often_as_taken(documents):
    _, frame = documents
    taken = Counter()
    for r in mixing.mixed(frame).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_rows(frame)
    assert out.columns == frame.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len((r.text or "").encode().split())
    assert words == Counter({k: v for k, v in taken.items() if v})


def brute_boundaries(histogram, buckets):
    best = None
    tops = [h[0] for h in histogram]
    for k in range(min(buckets, len(tops))):
        for cut in itertools.combinations(range(len(tops) - 1), k):
            ends = [*cut, len(tops) - 1]
            cost, start = 0, 0
            for e in ends:
                cost += sum(tops[e] * n - total for _, n, total in histogram[start : e + 1])
                start = e + 1
            best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 200), rng.choice([1, 2, 5, 9])))
    histogram = [(x, n := rng.randrange(1, 30), n * x) for x in lengths]
    for buckets in (1, 2, 3, 5):
        ends = packing.best_boundaries(histogram, buckets)
        assert len(ends) <= buckets and ends[-1] == lengths[-1]
        cost = sum(n * (min(e for e in ends if e >= x)) - total for x, n, total in histogram)
        assert cost == brute_boundaries(histogram, buckets)


def test_batches_hold_every_row_once(documents, no_documents):
    rows, frame = documents
    got = packing.packed(frame, packing.word_tokens(F.col("text")), buckets=4, budget=500).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len((r[1] or "").encode().split()) + 1) for r in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.padded_to
        batches[r.batch_id].append(r)
    assert sorted(batches) == list(range(len(batches)))
    for batch in batches.values():
        assert len({(r.bucket, r.padded_to) for r in batch}) == 1
        assert sorted(r.place for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0].padded_to <= 500
    histogram = Counter(r.n_tokens for r in got)
    items = [(x, n, x * n) for x, n in sorted(histogram.items())]
    ends = packing.best_boundaries(items, 4)
    assert {r.padded_to for r in got} == set(ends)
    assert packing.packed(no_documents, packing.word_tokens(F.col("text"))).count() == 0


def test_histogram_bins_are_few_and_cover(spark):
    lengths = [0, 1, 4095, 4096, 4097, 8191, 8192, 8193, 100_000, 10_000_000]
    frame = spark.createDataFrame([(x,) for x in lengths], "length bigint")
    got = {r.length: r.bin for r in frame.select("length", packing.length_bin(F.col("length")).alias("bin")).collect()}
    assert all(x <= b <= x * (1 + 1 / 1024) for x, b in got.items())
    assert all(got[x] == x for x in lengths if x <= 4096)


def test_ledger_matches_sql(documents):
    rows, frame = documents
    found = rules.verdict(rules.ledger(frame))
    same_as_sql(found, frame, rules.sql())
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == base and not (base and r.kept)


def test_measurements_by_hand(spark, no_documents):
    eight = "a b c d e f g h"
    texts = [f"{eight} x {eight}", f"{eight} a b c d e f g h a b c d e f g h", "l1 #\n\nl1 #\n \nl2 <>", None]
    rows = rules.ledger(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert [got[i].n_repeat_words for i in range(4)] == [16, 24, 0, 0]
    assert (got[2].n_symbols, got[2].n_dup_lines, got[2].n_lines, got[2].word_chars) == (4, 1, 3, 10)
    assert (got[3].n_words, got[3].failed) == (0, 1)
    assert rules.ledger(no_documents).count() == 0


def test_policies_and_ablations(documents):
    _, frame = documents
    found = rules.ledger(frame)
    rows = found.collect()
    for version in rules.POLICIES:
        enforced = rules.mask(rules.POLICIES[version])
        got = {r.rule: r for r in rules.ablations(found, version).collect()}
        for bit, (name, _) in enumerate(rules.RULES):
            if enforced >> bit & 1:
                masks = [r.failed & enforced for r in rows]
                assert got[name].failing == sum(m >> bit & 1 for m in masks)
                assert got[name].failing_alone == sum(m == 1 << bit for m in masks)
                assert got[name].kept_without == sum(m & ~(1 << bit) == 0 for m in masks)


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None if i % 2 else 5, f"text number {i} " + "word " * (i % 40), "a") for i in range(1500)]
    rows += [(9000 + i, "other words here " * 30, "b") for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for r in mixing.source_report(mixing.mixed(frame)).collect():
        assert 0 <= r.target - r.taken < 100
