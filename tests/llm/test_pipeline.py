"""Every stage on its own input, against a plain version, and the whole run."""

from collections import Counter

import corpus_pipeline
from basketry.llm import mixing
from tests.llm.test_nearcopies import brute_classes
from tests.llm.test_substrings import plain


def test_stages_one_after_the_other(spark, documents, tmp_path):
    rows, docs = documents
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = before = docs
        out = stage(spark, docs, "")
        if name != "pack":
            assert out.columns == before.columns and out.dtypes == before.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        given = before.collect()
        if name == "language_id":
            assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in given if any(c.isalpha() for c in r.text or ""))
        elif name == "near_dedup":
            classes = brute_classes([r.text for r in given])
            order = lambda r: r.doc_id if r.doc_id is not None else 1 << 63
            first = {}
            for r, c in zip(given, classes):
                first[c] = min(first.get(c, 1 << 64), order(r))
            # where one id stands for different texts, each class that it leads keeps it once
            assert {order(r) for r in got} == set(first.values())
            assert len(got) == len({order(r) for r in got})
        elif name == "substring_dedup":
            expected = plain([(r.doc_id, r.text) for r in given], 50)
            kept = {(i, t if gone else None) for i, _, gone, t in expected}
            assert {(r.doc_id, r.text) for r in got if (r.doc_id, None) not in kept} <= kept
            assert len(got) == len(given)
        elif name == "mix_sources":
            times = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mixed(before).collect()}
            assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in times.items() if n})
        else:
            assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(r.text.encode().split()) + 1) for r in given)


def test_run_reads_the_whole_table(spark, tmp_path, documents):
    _, docs = documents
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert first and Counter(map(tuple, first)) == Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_empty_table(spark, no_documents):
    docs = no_documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
