import hashlib

import numpy as np

from basketry.llm import fingerprints


def jaccard(a, b):
    x, y = (set(fingerprints.digests(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_matches_plain_sets(documents):
    rows, frame = documents
    got = fingerprints.versions(frame).collect()
    assert len(got) == len(rows)
    # ids that stand once, in order; null ids come before them
    ids = sorted({r[0] for r in rows if r[0] is not None})
    by_id = {i: [r[1] or "" for r in rows if r[0] == i] for i in ids}
    seen = 0
    for r in got:
        if r.doc_id is None or r.doc_id == ids[-1] or len(by_id[r.doc_id]) > 1:
            continue
        following = by_id[ids[ids.index(r.doc_id) + 1]]
        text = by_id[r.doc_id][0]
        changed = {hashlib.sha256(fingerprints.edited(text, t).encode()).hexdigest(): t for t in following}
        assert r.edited_sha256 in changed
        after = changed[r.edited_sha256]
        assert r.n_chars == len(text)
        assert abs(r.near_edited - jaccard(text, fingerprints.edited(text, after))) < 1e-12
        if len(set(following)) == 1:
            assert abs(r.near_next - jaccard(text, after)) < 1e-12
        seen += 1
    assert seen > 60
    same = {}
    for r in got:
        same.setdefault(r.fingerprint, set()).add(r.n_chars)
    copies = [r.fingerprint for r in got if r.doc_id in (21, 1000, 1001)]
    assert len(set(copies)) == 1


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr("basketry.llm.common.ROWS_PER_PART", 3)
    rows = [(i, f"text {i}. and more {i % 4}.\n") for i in range(50)]
    got = {r.doc_id: r for r in fingerprints.versions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        expected = fingerprints.edited(t, rows[(i + 1) % 50][1])
        assert got[i].edited_sha256 == hashlib.sha256(expected.encode()).hexdigest()


def test_single_and_empty(spark, no_documents):
    one = spark.createDataFrame([(5, "alpha beta")], "doc_id bigint, text string")
    r = fingerprints.versions(one).collect()[0]
    assert r.edited_sha256 == hashlib.sha256(b"alphaalpha").hexdigest() and r.near_next == 1.0
    assert fingerprints.versions(no_documents).count() == 0


def test_peeling_recovers_the_differences():
    rng = np.random.default_rng(0)
    a, b, truth = [], [], []
    for n in (0, 1, 5, 40, 400, 3000):
        shared = rng.integers(1, 1 << 62, n).astype(np.uint64)
        x, y = rng.integers(1, 1 << 62, n // 2).astype(np.uint64), rng.integers(1, 1 << 62, n // 3 + 1).astype(np.uint64)
        a.append(np.concatenate((shared, x)))
        b.append(np.concatenate((shared, y)))
        truth.append(set(x.tolist()) | set(y.tolist()))
    n, found = fingerprints.differing(a, b)
    assert [set(f.tolist()) for f in found] == truth and n.tolist() == [len(t) for t in truth]


def test_repeated_and_long_paragraphs():
    twice = fingerprints.digests(b"one line\none line\nother")
    assert len(set(twice.tolist())) == 3
    long = b" ".join(b"word%d" % (i * 7919 % 1000) for i in range(600))
    pieces = fingerprints.paragraphs(long)
    assert len(pieces) > 20 and b" ".join(pieces) == long
    assert set(fingerprints.paragraphs(long + b" tail")) >= set(pieces[:-1])


def test_wrong_digests_that_look_right_end_and_do_no_harm(monkeypatch):
    """Checks of four bits let many sums of digests pass for one; peeling still ends with the true differences."""
    monkeypatch.setattr(fingerprints, "_check", lambda keys: keys & fingerprints.np.uint64(15))
    rng = fingerprints.np.random.default_rng(6)
    for n in (0, 1, 5, 40, 200):
        one = [fingerprints.np.unique(rng.integers(0, 2**63, n).astype("u8")) for _ in range(30)]
        two = [fingerprints.np.unique(fingerprints.np.concatenate((x[: len(x) // 2], rng.integers(0, 2**63, n // 3).astype("u8")))) for x in one]
        count, found = fingerprints.differing(one, two, 12)
        for a, b, k, f in zip(one, two, count, found):
            assert sorted(f.tolist()) == fingerprints.np.setxor1d(a, b).tolist() and k == len(f)


def test_pairs_that_never_peel_are_compared_digest_by_digest(monkeypatch):
    monkeypatch.setattr(fingerprints, "_check", lambda keys: keys * fingerprints.np.uint64(0) + fingerprints.np.uint64(1))
    one, two = [fingerprints.np.arange(50, dtype="u8")], [fingerprints.np.arange(30, 90, dtype="u8")]
    monkeypatch.setattr(fingerprints, "_peeled", lambda a, b: (fingerprints.np.zeros(0, "u8"), fingerprints.np.zeros(0, "i8"), fingerprints.np.zeros(a.n, bool)))
    count, found = fingerprints.differing(one, two)
    assert count.tolist() == [70] and sorted(found[0].tolist()) == [*range(30), *range(50, 90)]
