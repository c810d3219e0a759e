import hashlib
import random

import numpy as np
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from basketry.llm import pieces, queries
from basketry.llm.memory import WordMemory

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", "  ", " a", "a  b", "a\tb\n", "ﬁ½ＡＢ①㍿", "　x", "a​b", "é", "中文𝄞", "<s> </s> <unk>", "▁x", "a ▁ b",
    "\x00a", "a\r\nb", "   ", "  x  y  ", " a　 b ", "ｶﾞ ﷺ", "x" * 3000, " " * 500, "日本語" * 400,
]


def random_texts(n=300):
    rng = random.Random(1)
    letters = "abc  ́̈éﬁ①㍿ｶﾞ​\t\n中𝄞▁A  ïﷺ"
    return TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def model_with(rule, extra):
    """The public vocabulary with another compiled character map and other rules for white space."""
    with open(MODEL, "rb") as f:
        public = f.read()
    proto = SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for n, v, _ in pieces._fields(proto) if n == pieces.NORMALIZER) + extra
    rest = b"".join(raw for n, _, raw in pieces._fields(public) if n != pieces.NORMALIZER)
    return rest + bytes([pieces.NORMALIZER << 3 | 2]) + pieces._as_varint(len(spec)) + spec


def compare(model, texts):
    library, coder = SentencePieceProcessor(model_proto=model), pieces.PieceCoder(model)
    for text, (ids, begin, end) in zip(texts, coder.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begin.tolist(), end.tolist()))[1:-1] == spans
        assert coder.decode(ids) == library.decode(ids.tolist())


def test_the_public_model():
    with open(MODEL, "rb") as f:
        compare(f.read(), random_texts())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("extra", [b"", bytes([pieces.FEWER_SPACES << 3, 0]), bytes([pieces.DUMMY_PREFIX << 3, 0])])
def test_compiled_character_maps(rule, extra):
    compare(model_with(rule, extra), random_texts())


def test_longest_key_and_source_bytes():
    normalize = pieces.PieceCoder(model_with("nmt_nfkc", bytes([pieces.FEWER_SPACES << 3, 0]))).normalize
    out, align = normalize("①éx".encode())
    assert out.decode() == "▁1éx"
    assert align.tolist() == [0, 0, 0, 0, 3, 3, 6, 7]


def test_memory_in_two_generations():
    asked = []

    def encode(words):
        asked.append(list(words))
        return np.array([ord(c) for w in words for c in w], np.uint32), np.array([len(w) for w in words], np.int64)

    memory = WordMemory(encode, words=3, characters=1000)
    for words in ([], ["ab", "c", "ab"], ["d", "", "ef"], ["ab", "x", "ef"], ["x", "ab", "y"], ["ab", "z" * 2000], ["ab"]):
        ids, sizes = memory.ids(words)
        assert "".join(map(chr, ids)) == "".join(words) and sizes.tolist() == [len(w) for w in words]
    assert sum(a.count("ab") for a in asked) == 1  # passed on from generation to generation


def test_rows(spark, documents):
    rows, frame = documents
    library = SentencePieceProcessor(model_file=MODEL)
    truth = [library.encode(r[1] or "", add_bos=True, add_eos=True) for r in rows]
    expected = sorted((r[0] is None, r[0] or 0, len(t), np.array(t, "<u4").tobytes(), library.decode(t)) for r, t in zip(rows, truth))
    found = pieces.encoded(frame, MODEL, decode=True)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.decoded) for r in found.collect()) == expected
    again = pieces.decoded(found, MODEL)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in again.collect()) == sorted((a, b, e) for a, b, _, _, e in expected)


def test_piece_rows_cover_the_source(spark):
    texts = ["Plain words, twice  spaced", "naïve 中𝄞", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pieces.piece_rows(pieces.encoded(frame, MODEL)).orderBy("doc_id", "place").collect()
    for i, text in enumerate(texts):
        source, own = (text or "").encode(), [r for r in found if r.doc_id == i]
        assert [r.place for r in own] == list(range(len(own)))
        assert b"".join(source[r.begin : r.end] for r in own) == source
        assert (own[0].id, own[-1].id, own[-1].begin, own[-1].end) == (1, 2, len(source), len(source))


def test_empty_table_and_missing_ids(spark, no_documents):
    assert pieces.encoded(no_documents, MODEL, decode=True).count() == 0
    assert pieces.piece_rows(pieces.encoded(no_documents, MODEL)).count() == 0
    frame = spark.createDataFrame([(1, None)], "doc_id bigint, ids binary")
    assert pieces.decoded(frame, MODEL).collect() == [(1, "")]


def test_models_without_byte_pieces_are_refused():
    with open(MODEL, "rb") as f:
        model = f.read()
    kept = [raw for n, v, raw in pieces._fields(model) if n != pieces.PIECES or b"<0x" not in v]
    with pytest.raises(ValueError):
        pieces.PieceCoder(b"".join(kept))


def test_query_digests(spark, tmp_path):
    texts = random_texts(20) + [None]
    folder = f"{tmp_path}/t"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    library = SentencePieceProcessor(model_file=MODEL)
    for r in queries.op11_pieces(spark, folder).collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
