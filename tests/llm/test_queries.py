"""The registered text queries over the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from basketry.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_packing": ["doc_id", "n_tokens", "bucket", "padded_to", "batch_id", "place"],
    "op5_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_html": ["page_id", "url", "text", "n_chars"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op12_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op11_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


def test_every_operator_is_registered():
    found = entry_points.queries()
    assert set(COLUMNS) | {"pipeline"} <= set(found)
    assert set(queries.registered()) == set(COLUMNS)


# Queries that do not return one row per document or page.
OTHER_ROWS = {"op12_spelling", "op13_negatives"}


@pytest.mark.parametrize("name", sorted(OTHER_ROWS & set(COLUMNS)))
def test_columns(spark, name):
    assert queries.registered()[name](spark, SF_DIR).columns[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - OTHER_ROWS))
def test_one_row_per_document(spark, name):
    frame = queries.registered()[name](spark, SF_DIR)
    assert frame.columns[: len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(frame.columns)
    table = "pages" if name == "op9_html" else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in frame.select(key).collect()) == ids


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    names = sorted(queries.registered()[name](spark, SF_DIR).columns)
    got = sorted((tuple(r[c] for c in names) for r in queries.registered()[name](spark, SF_DIR).collect()), key=repr)
    expected = sorted(con.sql(queries.oracle_sql()[name]).select(", ".join(names)).fetchall(), key=repr)
    assert got == expected
