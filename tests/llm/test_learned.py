"""Language and toxicity: held-out accuracy and plain versions on small rows."""

import random
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from basketry.llm import language, toxicity
from basketry.llm.wordhash import words_of

LANGUAGES = {
    "en": "the and of to in that is was for with as on be at by this had not are but from or have an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
}


def plain_grams(text):
    found = Counter()
    word = ""
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word += c
        elif word:
            marked = f"_{word}_"
            found.update(word)
            found.update(marked[i : i + 2] for i in range(len(marked) - 1))
            found.update(marked[i : i + 3] for i in range(len(marked) - 2))
            word = ""
    return found


def test_grams_match_plain_counting(monkeypatch):
    texts = ["The cat, the CAT!", "", "..", "é1é ß_x", "Привет мир", "𐐀b a", "long " * 50, " x", "İstanbul"]
    for chunk in (1 << 20, 4):
        monkeypatch.setattr(language, "CHUNK", chunk)
        for text in texts:
            codes, counts = language.grams(text)
            got = {}
            for code, n in zip(codes.tolist(), counts.tolist()):
                points = [code >> s & 0x1FFFFF for s in (42, 21, 0)]
                gram = "".join("_" if p == 1 else chr(p - 1) for p in points if p)
                if any(p > 1 for p in points):
                    got[gram] = n
            assert got == dict(plain_grams(text)), (text, chunk)


def documents_in_languages(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choices(LANGUAGES[lang], k=rng.choice([8, 40]))), lang, 1.0))
    rows += [(9000, None, "en", 1.0), (9001, "12 34 .!", "en", 1.0), (9002, "", None, 1.0), (None, "the and of to in", None, 1.0)]
    rows += [(9003, "der die und das " * 20_000, None, 1.0)] * 2
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, SCORE double")


def test_language_of_held_out_documents(spark):
    rows, frame = documents_in_languages(spark)
    got = language.identified(frame).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    odd = {r.doc_id: r.lang_pred for r in got if r.doc_id is None or r.doc_id >= 9000}
    assert odd == {9000: "und", 9001: "und", 9002: "und", None: "en", 9003: "de"}


def test_rejected_documents_go_and_nothing_learned_is_unknown(spark, no_documents):
    rows, frame = documents_in_languages(spark, 60)
    kept = language.accepted(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in (9000, 9001, 9002))
    assert language.identified(no_documents).count() == 0
    bare = frame.withColumn("lang", frame["lang"].substr(100, 1)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identified(bare).collect()} == {"und"}


def test_rank_is_the_out_of_place_distance():
    profiles = [("x", [5, 7, 9]), ("y", [9, 5])]
    ranker = language.Ranker(profiles, 10)
    mine = np.array([7, 9, 1000])
    at = {lang: {g: i for i, g in enumerate(codes)} for lang, codes in profiles}
    expected = [sum(abs(i - at[k][g]) if g in at[k] else 10 for i, g in enumerate(mine.tolist())) for k in ("x", "y")]
    place = np.minimum(np.searchsorted(ranker.known, mine), len(ranker.known) - 1)
    place = np.where(ranker.known[place] == mine, place, len(ranker.known))
    theirs = ranker.ranks[:, place]
    assert np.where(theirs < 0, 10, np.abs(theirs - np.arange(3))).sum(axis=1).tolist() == expected


def toxic_documents(spark, n=600):
    rng = random.Random(6)
    plain, bad = [f"word{i}" for i in range(300)], ["blockhead", "nitwit", "imbecile"]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.choice([1, 6, 30]))]
        toxic = rng.random() < 0.25
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(bad).upper() + ", you"
        rows.append((i, rng.choice([". ", "!\n", "? "]).join(sentences), "l", 0.5, "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(7000, None, "l", 0.5, "x"), (7001, "", "l", 0.5, "x"), (None, "a nitwit. fine", "l", 0.5, "x"), (7002, "ok. " * 30_000, "l", 0.5, "x")]
    labels += [(7000, 1, 0), (7001, 0, None), (None, 1, 1), (5, 1, labels[5][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, Score double, weights string")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxic_documents_and_sentences_are_found(spark, no_documents):
    rows, labels, docs, frame = toxic_documents(spark)
    got = toxicity.classified(docs, frame).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in labels[:600]}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    odd = {r.doc_id: (r.score, r.n_sentences) for r in got if r.doc_id in (7000, 7001)}
    assert odd == {7000: (0.0, 0), 7001: (0.0, 0)}
    model = toxicity.learned_model(docs, frame)
    found = toxicity.offending_sentences(docs, model).collect()
    assert len(found) > 80
    for r in found:
        assert any(b in r.sentence.lower() for b in ("blockhead", "nitwit", "imbecile"))
    worst = {r.doc_id: r.worst for r in got if r.n_toxic == 1}
    assert all(worst[r.doc_id] == r.place for r in found if r.doc_id in worst)
    nothing = toxicity.classified(docs, frame.limit(0)).collect()
    assert all(r.predicted == 0 for r in nothing)
    assert toxicity.classified(no_documents, frame).count() == 0


def test_word_hashes_tell_words_apart_and_ignore_position():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abä", k=rng.randrange(1, 6))) for _ in range(rng.randrange(60))).encode() for _ in range(50)]
    texts += [b"", b" \t", b"x" * 3_000_000 + b" y", "nb sp".encode()]
    found = words_of(texts)
    flat = [w for t in texts for w in t.split()]
    assert [found.buffer[a:b] for a, b in zip(found.start, found.end)] == flat
    assert found.count.tolist() == [len(t.split()) for t in texts]
    assert found.text.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    by_word = {}
    for w, h in zip(flat, found.hash.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_two_runs_learn_the_same_model(spark):
    """Also from rows in another order, and from ids that several texts share."""
    rows, _, docs, frame = toxic_documents(spark)
    twice = docs.union(spark.createDataFrame([(i, "another text. " * (1 + i % 3), "l", 0.5, "x") for i in range(0, 300, 7)], docs.schema))
    one, two = (toxicity.learned_model(d, frame) for d in (twice.repartition(3), twice.repartition(7, "text")))
    assert one.keys.tolist() == two.keys.tolist() and len(one.keys) > 0
    assert one.weights.tolist() == two.weights.tolist() and one.leak == two.leak


def test_a_sample_of_too_many_bytes_is_thinned_out(spark, monkeypatch):
    rows, _, docs, frame = toxic_documents(spark)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    known = frame.select(F.col("doc_id").alias("_id"), F.lit(1).alias("toxic")).where("doc_id IS NOT NULL").distinct()
    held = toxicity._sampled(docs, known).agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < held < 40_000


def test_the_first_step_against_plain_sums():
    """One round of the fit by hand: risks per sentence, noisy-or per text, slopes per word."""
    used = np.array([3, 8], np.uint64)
    column, sentence = np.array([0, 1, 0]), np.array([0, 0, 2])
    owner, label, weight = np.array([0, 0, 1]), np.array([1.0, 0.0]), np.array([1.0, 2.0])
    model = toxicity.fitted(used, column, sentence, owner, label, weight, rounds=1)
    soft = lambda z: np.log1p(np.exp(z))
    leak = np.log(1 / 3)
    z = [toxicity.BASE + 1.0, toxicity.BASE, toxicity.BASE + 0.5]
    s = [soft(z[0]) - soft(toxicity.BASE) + soft(leak), soft(z[2]) - soft(toxicity.BASE) + soft(leak)]
    slope = [-1 / np.expm1(s[0]) / 3, 2 / 3]
    g = [slope[0] / (1 + np.exp(-z[0])) + slope[1] / (1 + np.exp(-z[2])), slope[0] / (1 + np.exp(-z[0]))]
    expected = []
    for x in g:
        m, v = 0.1 * x, 0.01 * x * x
        pace = toxicity.STEP / (np.sqrt(v / 0.01) + 1e-9)
        expected.append(max(0.0, 0.5 - pace * m / 0.1 - pace * toxicity.PENALTY / 3))
    full = dict(zip(model.keys.tolist(), model.weights.tolist()))
    np.testing.assert_allclose([full.get(3, 0.0), full.get(8, 0.0)], expected)
