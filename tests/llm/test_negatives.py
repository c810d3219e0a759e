import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import common, covertree, negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, `row` string, place int, `Block` string"


def make_rows(n=400, d=6, seed=5):
    """Clusters, copies, ties, zero vectors, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = []
    for i in range(n):
        kind = i % 5
        v = centres[i % 12] + rng.normal(size=d) * (0.02 if kind < 3 else 0.6)
        if kind == 4 and i % 3 == 0:
            v = centres[0]
        rows.append([i, [float(np.float32(x)) for x in v], int(rng.integers(4))])
    for i, bad in ((3, None), (11, [None] + [0.1] * (d - 1)), (19, [math.nan] * d), (27, [math.inf] * d), (33, [-math.inf] * d)):
        rows[i][1] = bad
    rows[50][1] = [0.0] * d
    rows[60][1] = [0.0] * d
    rows[41][2] = None
    rows += [[100, rows[100][1], rows[100][2]], [150, rows[7][1], 2], [None, rows[8][1], 1]]
    return [(*r, "x", 1, "b") for r in rows]


def plain(rows):
    taken = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(np.array(v) * 256)))
    out = []
    for a, (i, label, v) in enumerate(taken):
        if i % 50:
            continue
        scored = [(-int(w @ v), j, other == label) for b, (j, other, w) in enumerate(taken) if b != a]
        for minus, j, _ in sorted(s for s in scored if s[2])[:5]:
            near = [s for s in scored if not s[2] and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(i, j, r, s[1], -minus, -s[0]) for r, s in enumerate(sorted(near)[:3], 1)]
    return sorted(out)


def mined(frame):
    rows = negatives.labelled(frame, negatives.contract_label())
    return sorted(map(tuple, negatives.mined(rows, F.col("vec_id") % 50 == 0).collect()))


@pytest.mark.parametrize("size", [(2048, 1024), (40, 3)])
def test_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", size[0])
    monkeypatch.setattr(negatives, "ANCHORS", size[1])
    rows = make_rows()
    expected = plain(rows)
    assert len(expected) > 60
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(7)) == expected


def test_sql_says_the_same(spark):
    rows = [r for r in make_rows() if r[0] is not None and r[0] < 400][:400]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r[:3]) for r in rows])
    assert sorted(con.sql(negatives.sql()).fetchall()) == plain(rows)


def test_one_vector_for_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(2)
    vectors = [[0.5, 0.5, 0.1]] * 100 + rng.normal(size=(200, 3)).astype(np.float32).tolist()
    rows = [(i, v, i % 3, "x", 1, "b") for i, v in enumerate(vectors)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_vectors_of_other_lengths_are_filled_with_zeros(spark):
    rows = [(i, [0.1 * i] * (1 + i % 4), i % 2, "x", 1, "b") for i in range(60)] + [(100, [], 1, "x", 1, "b")]
    full = [(i, list(np.float32(v + [0.0] * (4 - len(v))).astype(float)), *rest) for i, v, *rest in rows]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(full)


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "x", 1, "b")], [(50, [1.0, 2.0], 1, "x", 1, "b")], [(1, [1.0], 1, "x", 1, "b")]])
def test_nothing_to_find(spark, rows):
    assert mined(spark.createDataFrame(rows, SCHEMA)) == []


def tree_and_points(n, d=5, seed=0):
    rng = np.random.default_rng(seed)
    points = np.floor(rng.normal(size=(n, d)) * 40)
    points[: n // 2] = points[0] + np.floor(rng.normal(size=(n // 2, d)) * 2)
    reach = float(np.sqrt((points**2).sum(1).max()))
    ids = rng.permutation(n)
    return covertree.built(points, ids, np.arange(n), ids % 3, reach), points


def test_radii_cover_and_centres_are_apart(monkeypatch):
    monkeypatch.setattr(covertree, "SMALL_NODE", 6)
    monkeypatch.setattr(covertree, "LEAF", 2)
    tree, points = tree_and_points(300)
    assert sorted(tree.rows.tolist()) == list(range(300))
    lifted = np.column_stack((tree.points, np.sqrt(np.maximum(0, tree.reach**2 - (tree.points**2).sum(1)))))

    def members(node):
        own = list(range(tree.own_from[node], tree.own_to[node]))
        return own + [m for c in range(tree.child_from[node], tree.child_to[node]) for m in members(c)]

    assert len(tree.centre) > 5
    for node in range(len(tree.centre)):
        gaps = np.linalg.norm(lifted[members(node)] - lifted[tree.centre[node]], axis=1)
        assert gaps.max() <= tree.radius[node] + 1e-9
        children = tree.centre[tree.child_from[node] : tree.child_to[node]]
        for i in range(len(children)):
            assert tree.radius[tree.child_from[node] + i] <= tree.radius[node] / 2 + 1e-9
            for j in range(i):
                assert np.linalg.norm(lifted[children[i]] - lifted[children[j]]) > tree.radius[node] / 2 - 1e-9


def test_search_opens_few_nodes_and_finds_all(monkeypatch):
    monkeypatch.setattr(covertree, "SMALL_NODE", 6)
    monkeypatch.setattr(covertree, "LEAF", 2)
    tree, _ = tree_and_points(600, seed=4)
    again = covertree.Tree.from_bytes(tree.to_bytes())
    queries, rows, labels = tree.points[:20], tree.rows[:20], tree.labels[:20]
    best = (queries @ tree.points.T).max(1)
    low, high = np.column_stack((best * 0.5, best * 0.2)), np.column_stack((best * 0.9, best * 0.1))
    opened = []
    verify = covertree.Search._verify
    monkeypatch.setattr(covertree.Search, "_verify", lambda self, who, node: (opened.append(node), verify(self, who, node)))
    query, window, score, point = covertree.Search(again, queries, rows, labels, low, high, False, 3).run()
    got = {}
    for q, w, s, p in sorted(zip(query, window, -score, point), key=lambda x: (x[0], x[1], x[2], again.ids[x[3]])):
        got.setdefault((int(q), int(w)), []).append((int(-s), int(again.ids[p])))
    expected = {}
    for q in range(20):
        scores = tree.points @ queries[q]
        fits = [(-int(s), int(i)) for s, i, r, b in zip(scores, tree.ids, tree.rows, tree.labels) if b != labels[q] and low[q, 0] <= s <= high[q, 0]]
        if fits:
            expected[q, 0] = [(-s, i) for s, i in sorted(fits)[:3]]
    assert got == expected and len(expected) > 5
    assert len(set(opened)) < len(tree.centre)


def test_rounding_never_hides_a_tie():
    """Large scores: the k first of equal ones by id, also where scores times columns leave exact doubles."""
    for factor in (1.0, 2.0**45):
        scores = np.array([[3.0, 5.0, 5.0, -np.inf, 5.0, 1.0]]) * factor
        line, column = covertree._first(scores, 2)
        assert sorted(column.tolist()) == [1, 2] and line.tolist() == [0, 0]


def test_shelves_of_trees_meet_piles_of_queries(spark, monkeypatch):
    """A tree goes to a pile of queries once, not beside every chunk of them in an Arrow batch; groups have bounded bytes at any size."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = make_rows()
    taken = negatives.labelled(spark.createDataFrame(rows, SCHEMA).repartition(7), negatives.contract_label())
    forest = negatives.Forest(taken)
    ends = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    near = forest.best(taken.withColumns({"low": ends[0], "high": ends[1]}), 1, True, 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "\nMapInArrow" not in plan and " MapInArrow" not in plan
    monkeypatch.setattr(negatives.Forest, "_meetings", lambda *_: (3, 2))
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)
    monkeypatch.undo()
    for forest.blocks, forest.width, chunks in ((7_700, 64, 301), (7_700, 100_000, 301), (3, 64, 1), (400, 64, 12)):
        shelves, piles = forest._meetings(chunks, 5)
        assert 1 <= shelves <= forest.blocks and 1 <= piles <= chunks
        trees, queries = -(-forest.blocks // shelves), -(-chunks // piles)
        assert trees == 1 or trees * negatives.BLOCK_ROWS * 8 * forest.width <= negatives.MEETING_BYTES
        assert queries == 1 or queries * negatives.ANCHORS * 8 * forest.width <= negatives.MEETING_BYTES


def test_trees_together_are_one_tree(monkeypatch):
    monkeypatch.setattr(covertree, "SMALL_NODE", 6)
    monkeypatch.setattr(covertree, "LEAF", 2)
    one, points = tree_and_points(600, seed=4)
    ids, rows, labels = (x[np.argsort(one.rows)] for x in (one.ids, one.rows, one.labels))
    shelf = [covertree.built(points[i::4], ids[i::4] // 2, rows[i::4], labels[i::4], one.reach) for i in range(4)]
    queries, low = points[:40], np.tile([[-np.inf, 300.0, 5.0]], (40, 1))
    high = np.tile([[np.inf, 900.0, 4.0]], (40, 1))
    for same in (True, False):
        found = covertree.best_of(shelf, queries, rows[:40], labels[:40], low, high, same, 3)
        got = list(zip(*(x.astype(int).tolist() for x in found)))
        expected = []
        for q in range(40):
            for w in range(3):
                fits = [
                    (-int(s), int(i) // 2, int(r))
                    for s, i, r, b in zip(points @ queries[q], ids, rows, labels)
                    if (b == labels[q]) == same and r != rows[q] and low[q, w] <= s <= high[q, w]
                ]
                expected += [(q, w, -s, r, i) for s, i, r in sorted(fits)[:3]]
        assert got == expected and len(got) > 100


def test_long_rows_are_written_in_pages_of_bounded_bytes(spark):
    """A page is decompressed as a whole, outside the heap; 50 trees of 300 kB would be one page."""
    rows = spark.range(0, 50, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 5000), i -> sha2(concat(id, '-', i), 256)), '') as binary)").alias("tree"))
    parquet, hadoop = spark._jvm.org.apache.parquet.hadoop, spark._jvm.org.apache.hadoop

    def pages(table):
        file = parquet.util.HadoopInputFile.fromPath(hadoop.fs.Path(table.inputFiles()[0]), spark._jsc.hadoopConfiguration())
        reader = parquet.ParquetFileReader.open(file)
        try:
            blocks = reader.getFooter().getBlocks()
            return sum(reader.readOffsetIndex(b.getColumns().get(1)).getPageCount() for b in blocks)
        finally:
            reader.close()

    table = common.settled(rows, long_rows=True)
    assert pages(table) >= 10 and table.count() == 50
    assert pages(common.settled(rows)) < 3
