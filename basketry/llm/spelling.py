"""Spelling variants: words one letter apart, grouped under their frequent form, by FM-index search schemes.

The vocabulary is counted in Spark and written. Words in alphabetical order are cut into blocks of about
``BLOCK_SYMBOLS`` letters, and once more in the order of their reversed letters. A word asks the blocks
of the first order that can hold words with its left half, and those of the second that can hold words with its
right half, usually one or two each; there an index over the block's words answers by the scheme that takes that
half as exact. A block that very many words ask (a half that many words share) is searched in several tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import settled
from basketry.llm.fmindex import Index

BLOCK_SYMBOLS = 1 << 17
# Words that ask one index in one task.
ASKING = 1 << 17
# Leading letters of a block's first and last word that are compared; longer halves are taken as equal there.
EDGE = 64

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered_runs(text: Column, least: int = 1) -> Column:
    """Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of at least ``least`` letters with A-Z in lower case; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(plain, F.lit(f"([a-z\\u00C0-\\u00FF]{{{least},}})"), F.lit(1))


def thinned(run: Column, doc_id: Column, modulus: int) -> Column:
    """The run, or without one letter where ``modulus`` divides the checksum of ``<doc_id>:<run>``; no id is empty."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    gone = (mark % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), gone), F.substring(run, gone + 2, F.length(run)))
    return F.when(mark % modulus == 0, shorter).otherwise(run)


def vocabulary(docs: DataFrame, modulus: int, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts (doc_id, text), written. Rows that repeat an id count one by one."""
    run = docs.select("doc_id", F.explode(lowered_runs(F.col("text"), least_letters)).alias("run"))
    word = run.select(thinned(F.col("run"), F.col("doc_id"), modulus).alias("word"))
    counted = word.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return settled(counted.where(F.col("n") >= least_count))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair, both ways, of different words that one inserted, deleted or replaced code point tells apart.

    ``words`` has (word, n), each word once and none empty; it is read several times.
    """
    count, letters = words.agg(F.count("*"), F.sum(F.length("word"))).first()
    if not count:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    blocks = max(1, -(-(letters + count) // BLOCK_SYMBOLS))
    return _by_half(words, blocks, True).unionByName(_by_half(words, blocks, False))


def _by_half(words: DataFrame, blocks: int, left: bool) -> DataFrame:
    """The pairs whose error is not in the left (right) half of the word that asks."""
    key = F.col("word") if left else F.reverse("word")
    dealt = words.select("word", "n", key.alias("key")).repartitionByRange(blocks, "key")
    placed = settled(dealt.withColumn("block", F.spark_partition_id()))
    # two edges per block, one block per BLOCK_SYMBOLS letters of the vocabulary
    edges = placed.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = edges.select("block", F.substring("low", 1, EDGE).alias("low"), F.substring("high", 1, EDGE).alias("high"))
    held = sorted(edges.collect(), key=lambda r: r.low)
    numbers, lows, highs = ([r[i] for r in held] for i in range(3))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, rows = [], []
            for i, (word, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                half = key[: min(EDGE, len(word) // 2 if left else len(word) - len(word) // 2)]
                first, last = bisect_left(highs, half), bisect_right(lows, half, key=lambda low: low[: len(half)])
                block.extend(numbers[first:last])
                rows.extend([i] * (last - first))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64()))], ["block", "word"])

    asked = settled(placed.select("word", "key").mapInArrow(ask, "block int, word string"))
    parts = (F.floor((F.count("*") - 1) / ASKING) + 1).cast("int")
    spread = F.broadcast(words.sparkSession.createDataFrame(asked.groupBy("block").agg(parts.alias("parts")).toArrow()))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part")
    asking = asked.join(spread, "block").select("block", part, "word")
    indexed = placed.join(spread, "block").select(
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "word", "n"
    )

    def search(_, own: pa.Table, others: pa.Table) -> pa.Table:
        patterns, names = others.column("word").combine_chunks(), own.column("word").combine_chunks()
        if not len(patterns) or not len(names):
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        who, found = Index(names.to_pylist()).near(patterns.to_pylist(), left)
        found = pa.array(found)
        return pa.table({"word": patterns.take(pa.array(who)), "near": names.take(found), "near_n": own.column("n").take(found)})

    together = indexed.groupBy("block", "part").cogroup(asking.groupBy("block", "part"))
    return together.applyInArrow(search, "word string, near string, near_n bigint")


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``words`` (word, n).

    ``form`` is the near word of largest n, of equal ones the first in code-point order, if that n is at least
    ``times`` the word's own; ``root`` is where the forms lead. With ``times`` above 1 they never lead back.
    """
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    most = -F.col("best.minus")
    form = F.when(most >= F.col("n") * times, F.col("best.near"))
    rows = settled(
        words.join(near, "word", "left").select(
            "word",
            form.alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(form.isNotNull(), most).alias("form_n"),
        )
    )
    roots = _roots(rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): a link goes on from where it leads until none does; the way covered doubles in every round."""
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = links.join(onward, "root", "left")
        moved = settled(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def sql() -> str:
    """The contract as DuckDB SQL; the checksum is worked out byte by byte, words meet on what a deletion leaves."""
    return f"""
WITH RECURSIVE steps AS (
  SELECT list(code ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b:
             CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS code
    FROM range(256) t(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                           '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run
  FROM documents),
bytes AS (
  SELECT run, list_transform(range(octet_length(encode(line))), lambda i:
           CAST(('0x' || substr(hex(encode(line)), 2 * i + 1, 2)) AS BIGINT)) AS codes, n
  FROM (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS line, count(*) AS n FROM runs GROUP BY ALL)),
marked AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, codes), lambda a, b:
           xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS mark
  FROM bytes, steps),
counted AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN mark % 31 = 0
                   THEN substr(run, 1, CAST(mark % length(run) AS INT)) || substr(run, CAST(mark % length(run) AS INT) + 2)
                   ELSE run END AS word
    FROM marked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM counted)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN counted b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN counted b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min({{'minus': -near_n, 'near': near}}) AS top FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT c.word, CASE WHEN -top.minus >= 10 * n THEN top.near END AS form, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -top.minus >= 10 * n THEN -top.minus END AS form_n
  FROM counted c LEFT JOIN best b ON c.word = b.word),
paths AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON p.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT p.word, p.root FROM paths p JOIN formed f ON p.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
