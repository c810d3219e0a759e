"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule. A policy is a version name and the set of rules it enforces; applying one is a bitwise AND.
Ablations (what would a policy keep without one of its rules) come from counts of bit patterns, of
which there are at most two to the number of rules, however many documents there are.

Everything is a built-in function on one row. Nothing is exploded or shuffled to measure a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basketry.llm.common import SPACES, words

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rules in bit order: a name and a condition on the measurements that is true if the document fails.
# Bits never change their meaning; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("repeated_lines", "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("shouting", "10 * n_upper > 6 * word_chars"),
)
BASE = ("few_words", "repeated_words")
# Versioned policies: the rules each enforces beside the base rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "1": BASE,
    "2": BASE + ("symbols", "repeated_lines"),
    "3": tuple(name for name, _ in RULES),
}
CURRENT = "3"


def mask(rules: tuple[str, ...]) -> int:
    """The bits of a set of rules; an unknown name raises."""
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in set(rules))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def with_measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, measurements): the row as a struct and one column per measurement; a null text measures as empty."""
    found = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = found.withColumn("w", words(F.col("t")))
    found = found.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: _without(x, " " + SPACES) > 0))
    spans = F.when(
        F.size("w") >= REPEAT_WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("w") - (REPEAT_WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("w", i, REPEAT_WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    found = found.withColumn("spans", spans)
    found = found.withColumn("repeats", F.size("spans") > F.size(F.array_distinct("spans")))
    # only texts with a repeated span are sorted: equal spans become neighbours
    paired = F.array_sort(F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    found = found.withColumn("sorted", F.when(F.col("repeats"), paired).otherwise(nothing))

    def has_twin(s: Column, i: Column) -> Column:
        return F.coalesce(F.get("sorted", i - 1)["h"] == s["h"], F.lit(False)) | F.coalesce(
            F.get("sorted", i + 1)["h"] == s["h"], F.lit(False)
        )

    found = found.withColumn("starts", F.array_sort(F.transform(F.filter("sorted", has_twin), lambda s: s["i"])))
    covered = F.transform(
        "starts", lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(REPEAT_WINDOW)))
    )
    n_repeat = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(
        "row",
        F.size("w").cast("bigint").alias("n_words"),
        _without(F.col("t"), " " + SPACES).cast("bigint").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        (F.length("t") - _without(F.col("t"), UPPER)).cast("bigint").alias("n_upper"),
    )


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, one bit per failed rule, for every row of ``docs``.

    Null and empty texts have no words and fail ``few_words`` only. Repeated rows and null ids are rows
    like any other; other columns are not read. An empty table gives an empty ledger.
    """
    measured = with_measurements(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    bits = F.lit(0).cast("bigint")
    for bit, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << bit)).otherwise(0).cast("bigint"))
    return measured.withColumn("failed", bits).select(
        F.col("row.doc_id").alias("doc_id"), *[c for c in measured.columns if c != "row"], "failed"
    )


def verdict(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy version. Base rules hold in every version."""
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    policy = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version] + BASE))) == 0
    return rows.withColumns({"base_failed": base, "kept": policy})


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and kept without it.

    Documents are first counted by bit pattern, so the rules are compared on a few rows.
    """
    enforced = mask(POLICIES[version] + BASE)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(enforced)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(name, 1 << bit) for bit, (name, _) in enumerate(RULES) if enforced >> bit & 1]
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for n, b in rules]))
    return (
        patterns.select("bits", "n", one.alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.expr("if(bits & bit != 0, n, 0)")).alias("failing"),
            F.sum(F.expr("if(bits = bit, n, 0)")).alias("failing_alone"),
            F.sum(F.expr("if(bits & ~bit = 0, n, 0)")).alias("kept_without"),
            F.bit_or("bits").alias("seen_bits"),
        )
    )


def sql(table: str = "documents") -> str:
    """doc_id, measurements and verdict of the current policy in the SQL of another engine."""
    failed = " + ".join(f"(case when {fails} then {1 << bit} else 0 end)" for bit, (_, fails) in enumerate(RULES))
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from {table}),
        w as (select *, regexp_extract_all(t, '{word}') as w,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from d),
        s as (select r, unnest(range(1, len(w) - {REPEAT_WINDOW} + 2)) as i, w from w where len(w) >= {REPEAT_WINDOW}),
        h as (select r, i, array_to_string(w[i:i + {REPEAT_WINDOW - 1}], ' ') as span from s),
        x as (select r, i from h qualify count(*) over (partition by r, span) > 1),
        c as (select r, count(distinct i + k) as n_repeat_words from x, range({REPEAT_WINDOW}) as q(k) group by r),
        m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols,
                len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
                (length(t) - length(translate(t, '{UPPER}', '')))::bigint as n_upper
            from w left join c using (r)),
        f as (select *, ({failed})::bigint as failed from m)
        select *, (failed & {mask(BASE)}) <> 0 as base_failed,
            (failed & {mask(POLICIES[CURRENT] + BASE)}) = 0 as kept from f"""
