"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.llm import fingerprints, html, language, mixing, negatives, packing, pieces, rules, simhash, spelling, substrings, tokens, toxicity
from basketry.llm.common import words
from basketry.session import scratch_path, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.packed(docs, packing.word_tokens(F.col("text")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    folder = scratch_path(spark, "tokens", uuid.uuid4().hex)
    tokens.write_tokens(_table(spark, sf_dir, "documents"), folder, path("word_bpe_49k.json"))
    return tokens.read_tokens(spark, folder)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.array_join(words(F.col("text")), " ").cast("binary"), 256)
    return substrings.deduplicated(docs).select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdict(rules.ledger(_table(spark, sf_dir, "documents")))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    rows = pieces.encoded(_table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"), decode=True)
    return rows.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.crc32(F.concat("begins", "ends")).alias("spans_crc32"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.forms(spelling.vocabulary(_table(spark, sf_dir, "documents"), modulus=31))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.labelled(_table(spark, sf_dir, "embeddings"), negatives.contract_label())
    return negatives.mined(rows, F.col("vec_id") % 50 == 0)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_fingerprints": op3_fingerprints,
        "op4_packing": op4_packing,
        "op5_tokens": op5_tokens,
        "op6_language": op6_language,
        "op7_substrings": op7_substrings,
        "op8_rules": op8_rules,
        "op9_html": op9_html,
        "op10_mixing": op10_mixing,
        "op11_pieces": op11_pieces,
        "op12_spelling": op12_spelling,
        "op13_negatives": op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_rules": rules.sql(),
        "op10_mixing": mixing.sql(),
        "op12_spelling": spelling.sql(),
        "op13_negatives": negatives.sql(),
    }
