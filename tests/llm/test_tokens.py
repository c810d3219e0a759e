import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain(rows, path):
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return {(r[0], i): [*coder.encode(r[1] or "", add_special_tokens=False).ids, 2] for i, r in enumerate(rows)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_round_trip(spark, documents, tmp_path, monkeypatch, name):
    monkeypatch.setattr("basketry.llm.common.ROWS_PER_PART", 20)
    rows, frame = documents
    path = public_tokenizers.path(name)
    manifest = tokens.write_tokens(frame, f"file://{tmp_path}/t", path)
    got = tokens.read_tokens(spark, f"file:{tmp_path}/t").collect()
    truth = sorted((i is not None, i or 0, crc(ids), len(ids)) for (i, _), ids in plain(rows, path).items())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == truth
    assert len(manifest["shards"]) > 2 and manifest["dtype"] == "<u2"
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert manifest["n_tokens"] == at == sum((tmp_path / "t" / f"part-{s['part']:06d}.bin").stat().st_size for s in manifest["shards"]) // 2
    assert json.loads((tmp_path / "t" / "manifest.json").read_text()) == manifest


def test_empty_table(spark, no_documents, tmp_path):
    tokens.write_tokens(no_documents, f"{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_words_are_encoded_as_in_their_text(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [
        "It's THE naïve café ́x, 12345!! <|endoftext|> a<|startoftext|>b", "nb sp  em x\x1cy \x85z", "", " \n",
        "ΣΑΣ σας Σ. İ ǅ ﬁ", "emoji 👩‍👩‍👧 中文字 'll we'll", "​ zero ﻿",
    ]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    coder = tokens.WordTokens(path)
    assert coder.by_word
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    for _ in range(3):
        ids, counts = coder.encode([t.encode() for t in texts])
        cuts = np.cumsum(counts)[:-1]
        assert [x.tolist() for x in np.split(ids, cuts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not tokens.WordTokens(public_tokenizers.path("byte_bpe_50k.json")).by_word


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_strings_of_special_tokens_give_their_ids(spark, tmp_path, name):
    path = public_tokenizers.path(name)
    texts = ["hello <|endoftext|> world", "plain words", "<|startoftext|>a<|endoftext|>b <|endoftext|", "", "<|ENDOFTEXT|> x", None, "last  one"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens.write_tokens(frame, f"{tmp_path}/s", path)
    coder = Tokenizer.from_file(path)
    expected = [[*coder.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    got = sorted(tokens.read_tokens(spark, f"{tmp_path}/s").collect())
    starts = np.cumsum([0] + [len(e) for e in expected[:-1]]).tolist()
    assert [tuple(r) for r in got] == [(i, at, len(e), crc(e)) for i, (at, e) in enumerate(zip(starts, expected))]
    ids, counts = tokens.TextTokens(path).encode([(t or "").encode() for t in texts])
    assert ids.tolist() == [x for e in expected for x in e[:-1]] and counts.tolist() == [len(e) - 1 for e in expected]
