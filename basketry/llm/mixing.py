"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words. Whole epochs come first: a source whose target is 1.3 times its
size is taken once in full. The fraction that remains is drawn without replacement: a document has
the exponential key ``-ln(u) / weight``, u being a fixed hash of its id and text and weight its quality, and
documents are taken in key order while the running total fits the rest of the target.

No source is sorted or summed in one task. Keys fall into buckets of the unit interval; sums per
source and bucket find the bucket where the total is reached, and only that bucket is sorted. The
outcome is one row of cuts per source, so a document's share is an expression on its own row.

A document that does not fit ends a round; the next round goes on with documents that fit what is
left, so a target is missed by less than a small document after ROUNDS rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import cut_lineage, words
from basketry.operators.sizing import small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix"
ROUNDS = 6
BUCKETS = 4096
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document, 1 for plain prose and less with every symbol per word; 1 if there is no word."""
    plain = F.coalesce(text, F.lit(""))
    symbols = F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))
    return F.lit(1.0) / (F.lit(1.0) + symbols / F.greatest(size, F.lit(1)))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number above 0 and below 1 that is fixed by id and text: 52 bits of an MD5. Rows that share an id, or have
    none, are drawn one by one; only rows with the same id and text share a number."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), body)
    digits = F.substring(F.md5(name.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, key) per row; a null text has size 0."""
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.col(text).alias("_text"),
        F.size(words(F.col(text))).cast("bigint").alias("size"),
    )
    key = -F.log(draw(F.col("doc_id"), F.col("_text"))) / quality_weight(F.col("_text"), F.col("size"))
    return sized.select("doc_id", "source", "size", key.alias("key"))


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """(source, source_size, target) from one row per source: ``share`` of all sizes dealt by weight; a
    target stops at ``cap`` times its source's size and the excess goes to the others by weight.

    Dealing the excess again and again ends at ``min(cap, level * weight)``; the level follows from
    running totals over the sources in the order in which they reach their caps. The windows have
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("w"),
        (F.sum("source_size").over(everything) * share).alias("total"),
    ).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(later)
    levels = weighed.withColumn("level", level)
    # the first source that does not reach its cap has the final level
    chosen = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level")))
    final = levels.withColumn("final", F.coalesce(chosen.over(everything)["level"], F.lit(0.0)))
    return final.select("source", "source_size", F.least("cap", F.col("final") * F.col("w")).alias("target"))


def _picked(rounds: int) -> Column:
    """True for a row that one of the first ``rounds`` rounds has taken."""
    hit = F.lit(False)
    for r in range(rounds):
        hit = hit | ((F.col("size") <= F.col(f"left{r}")) & (F.col("key") <= F.col(f"cut{r}")))
    return hit & (F.col("size") > 0)


def source_cuts(slim: DataFrame, targets: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per source: size, target, whole epochs, and per round what was left and the last key taken."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("epochs", whole.cast("bigint"))
    state = cut_lineage(
        state.withColumn("left0", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of")
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    bucket = F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int")
    for r in range(rounds):
        pool = slim.join(small_side(state), same).where(
            (F.col("size") > 0) & (F.col("size") <= F.col(f"left{r}")) & ~_picked(r)
        )
        pool = pool.select("of", "size", "key", bucket.alias("bucket"))
        sums = pool.groupBy("of", "bucket").agg(F.sum("size").alias("words"), F.max("key").alias("last"))
        so_far = Window.partitionBy("of").orderBy("bucket")  # at most BUCKETS rows per source
        sums = sums.withColumn("upto", F.sum("words").over(so_far)).withColumn("before", F.col("upto") - F.col("words"))
        limit = state.select(F.col("of").alias("_of"), F.col(f"left{r}").alias("limit"))
        sums = cut_lineage(sums.join(small_side(limit), F.col("of").eqNullSafe(F.col("_of"))).drop("_of"))
        full = sums.where("upto <= limit").groupBy("of").agg(F.max("last").alias("cut"), F.max("upto").alias("got"))
        edge = sums.where("upto > limit and before <= limit").groupBy("of").agg(
            F.min(F.struct("bucket", "before", "limit")).alias("e")
        )
        edge = edge.select(F.col("of").alias("_of"), "e.*").withColumnRenamed("bucket", "at")
        inside = pool.join(small_side(edge), F.col("of").eqNullSafe(F.col("_of")) & (F.col("bucket") == F.col("at")))
        running = Window.partitionBy("of").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        inside = inside.withColumn("upto", F.sum("size").over(running) + F.col("before")).where("upto <= limit")
        inside = inside.groupBy("of").agg(F.max("key").alias("cut"), F.max("upto").alias("got"))
        reached = full.union(inside).groupBy("of").agg(F.max("cut").alias(f"cut{r}"), F.max("got").alias("got"))
        reached = reached.withColumnRenamed("of", "_of")
        state = state.join(reached, F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of")
        state = state.withColumns(
            {
                f"cut{r}": F.coalesce(f"cut{r}", F.lit(-1.0)),
                f"left{r + 1}": F.col(f"left{r}") - F.coalesce("got", F.lit(0)),
            }
        ).drop("got")
        state = cut_lineage(state)
    return state


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per row of ``docs``.

    ``taken`` is the words the mix takes of the row, repeats counted: size times 0, 1 or 2. Null and empty
    texts have size 0 and take nothing. A null source is a source like any other and the last in order.
    Rows that repeat an id, or have none, are drawn one by one by their texts; rows with the same id and the same
    text share a key, so a round takes all of them or none.
    An empty table gives an empty table; other columns are not read.
    """
    slim = cut_lineage(measured(docs, doc_id, text, source))
    state = _state(slim, weights, share, cap, rounds)
    joined = slim.join(small_side(state), F.col("source").eqNullSafe(F.col("of")))
    times = F.col("epochs") + F.when(_picked(rounds), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0, 1 or 2 times), in all their columns."""
    slim = cut_lineage(measured(docs, doc_id, text, source))
    state = _state(slim, WEIGHTS, SHARE, CAP, ROUNDS)
    size = F.size(words(F.col(text))).cast("bigint")
    names = docs.columns
    row = docs.select(F.struct(*names).alias("row"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), size.alias("size"))
    key = -F.log(draw(F.col("doc_id"), F.col("row")[text])) / quality_weight(F.col("row")[text], F.col("size"))
    joined = row.withColumn("key", key).join(small_side(state), F.col("source").eqNullSafe(F.col("of")))
    times = (F.col("epochs") + F.when(_picked(ROUNDS), 1).otherwise(0)).cast("int")
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return joined.select("row", F.explode(copies)).select("row.*")


def _state(slim: DataFrame, weights: tuple, share: float, cap: float, rounds: int) -> DataFrame:
    sizes = cut_lineage(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    return source_cuts(slim, source_targets(sizes, weights, share, cap), rounds)


def sql(table: str = "documents", rounds: int = ROUNDS) -> str:
    """The same mix in the SQL of another engine."""
    steps = []
    hit = "false"
    for r in range(rounds):
        steps.append(
            f"""p{r} as (select source, key, sum(size) over (partition by source order by key
                    range between unbounded preceding and current row) as upto, left{r}
                from s{r} where size > 0 and size <= left{r} and not ({hit})),
            c{r} as (select source, max(key) as cut, max(upto) as got from p{r} where upto <= left{r} group by source),
            s{r + 1} as (select a.*, coalesce(b.cut, -1) as cut{r}, left{r} - coalesce(b.got, 0) as left{r + 1}
                from s{r} a left join c{r} b on a.source is not distinct from b.source)"""
        )
        hit += f" or (size <= left{r} and key <= cut{r})"
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
        with d as (select doc_id, source, coalesce(text, '') as text from {table}),
        z as (select *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::bigint as size from d),
        k as (select doc_id, source, size, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null') || ':' || md5(text)), 1, 13))::bigint
                + 0.5::double) / 4503599627370496.0::double) / (1.0::double / (1.0::double
                + (length(text) - length(translate(text, '{SYMBOLS}', '')))::double / greatest(size, 1))) as key from z),
        g as (select source, sum(size)::bigint as source_size from k group by source),
        w as (select *, [{weights}][((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int] as w,
                {SHARE}::double * sum(source_size) over () as total, {CAP}::double * source_size as cap from g),
        l as (select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last
                    rows between unbounded preceding and 1 preceding), 0))
                / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w),
        f as (select *, coalesce((select level from l where level * w <= cap order by cap / w, level limit 1), 0) as final from l),
        t as (select source, source_size, least(cap, final * w) as target from f),
        e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
        s0 as (select k.doc_id, k.source, k.size, k.key, e.source_size, e.target, e.epochs,
                e.target - e.epochs * e.source_size as left0
            from k join e on k.source is not distinct from e.source),
        {", ".join(steps)}
        select doc_id, size, source_size, target,
            (size * (epochs + case when size > 0 and ({hit}) then 1 else 0 end))::bigint as taken
        from s{rounds}"""


def source_report(mix: DataFrame) -> DataFrame:
    """Words taken beside the target, per source."""
    return mix.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    )

