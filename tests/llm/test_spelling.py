import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from basketry.llm import fmindex, queries, spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[word] += len(word) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def made_documents(n=60, seed=4):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeé×") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    stems += ["aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "common" + "x" * 6, "short", "Übermäßig"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(80):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "z", "é", w[at] * 2]) + w[at + rng.randrange(2) :]
            words.append(w.title() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "9", "\n", "中"]).join(words)))
    rows += [(None, rows[0][1]), (None, None), (7, rows[7][1]), (900, ""), (901, "x" * 5000 + " " + "x" * 5001), (902, "y" * 5000 + "\t" + "x" * 5000)]
    rows += [(903, "y" * 5000)]
    # counts that lead over two forms to a root
    rows += [(910 + k, " ".join([w] * m)) for k, (w, m) in enumerate([("chainedone", 900), ("chainedon", 80), ("chainedin", 5)])]
    return [(*r, "k", 1, "n") for r in rows]


SCHEMA = "doc_id bigint, text string, `word` string, block int, `N` string"


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "a"])
def test_both_schemes_find_every_pair_once(alphabet, monkeypatch):
    monkeypatch.setattr(fmindex, "PATTERNS", 37)
    for seed in range(8):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(150)})
        patterns = words + ["zz", "", "a", "zab", "abz", "é中"]
        index = fmindex.Index(words)
        found = [(p, w) for left in (True, False) for p, w in zip(*(x.tolist() for x in index.near(patterns, left)))]
        expected = [(i, j) for i, a in enumerate(patterns) for j, b in enumerate(words) if one_apart(a, b)]
        assert sorted(found) == sorted(expected)


def test_a_scheme_takes_its_half_as_exact():
    index = fmindex.Index(["abcdxf", "xbcdef", "abcdef"])
    assert [x.tolist() for x in index.near(["abcdef"], True)] == [[0], [0]]
    assert [x.tolist() for x in index.near(["abcdef"], False)] == [[0], [1]]


def test_suffix_order():
    for text in ([1, 2, 1, 2, 1], [3] * 40, [], [5, 4, 3, 2, 1] * 9):
        found = fmindex.suffix_order(fmindex.np.array(text, "i8"), 6).tolist()
        assert found == sorted(range(len(text) + 1), key=lambda i: text[i:])


@pytest.mark.parametrize("blocks", [(1 << 17, 1 << 17), (400, 20)])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "BLOCK_SYMBOLS", blocks[0])
    monkeypatch.setattr(spelling, "ASKING", blocks[1])
    rows = made_documents()
    expected = plain(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, spelling.forms(spelling.vocabulary(frame, 31)).collect()), key=lambda r: r[0])
    assert got == expected
    found = {r[0]: r for r in expected}
    assert found["chainedin"][1:3] == ("chainedon", "chainedone") and len(expected) > 100
    assert "x" * 5000 in found


def test_sql_says_the_same():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [r for r in made_documents() if len(r[1] or "") < 5000]
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r[:2]) for r in rows])
    assert sorted(con.sql(spelling.sql()).fetchall(), key=lambda r: r[0]) == plain(rows)


def test_words_that_share_a_half(spark, monkeypatch):
    """One left half for most of the vocabulary: its blocks are searched in parts."""
    monkeypatch.setattr(spelling, "BLOCK_SYMBOLS", 300)
    monkeypatch.setattr(spelling, "ASKING", 10)
    rng = random.Random(1)
    words = sorted({"preffix" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    frame = spark.createDataFrame([(w, 2 + len(w) % 3) for w in words], "word string, n bigint")
    got = sorted(map(tuple, spelling.near_words(frame).collect()))
    assert got == sorted((a, b, 2 + len(b) % 3) for a in words for b in words if one_apart(a, b))


@pytest.mark.parametrize("rows", [[], [(1, None, "k", 1, "n")], [(1, "a few short ones", "k", 1, "n")], [(1, "lonesome", "k", 1, "n")]])
def test_no_words(spark, rows):
    assert spelling.forms(spelling.vocabulary(spark.createDataFrame(rows, SCHEMA), 31)).collect() == []


def test_query(spark, tmp_path):
    rows = made_documents(20)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_spelling(spark, str(tmp_path)).collect()), key=lambda r: r[0])
    assert got == plain(rows)
