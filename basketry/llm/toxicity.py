"""Toxicity by multiple-instance learning.

Only documents are labelled, but only some of their sentences are toxic. Every sentence gets a
probability from a linear model over hashed words; a document is toxic if at least one sentence is,
so the probabilities are combined by noisy-or, ``1 - (1 - leak) * prod(1 - p)``. The leak stands for what
words do not explain. A sentence without a telling word has probability 0, so that a long document is
not toxic for its length. The likelihood of the document labels trains the sentence model, which then
also locates the sentences that offend.

Features of a word are its lower-case form and, if it is longer, its leading bytes, each by a 64-bit hash.
The model is fitted in one task on a
bounded sample of labelled documents, SAMPLE at most in expectation and half of it per class, and of about
SAMPLE_BYTES at most, with weights that restore the class shares. Which words tell anything is counted by Spark first,
so only those reach that task. Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import arrow_pass, hash_share, settled, text_bytes
from basketry.llm.wordhash import words_of
from basketry.operators.sizing import small_side

MODULUS, HELD_OUT = 5, 0
SAMPLE = 16_000
SAMPLE_BYTES = 128 << 20
PREFIX = 6
ROUNDS = 200
STEP = 0.15
# A word needs this much gain in log likelihood per unit of weight, so that rare words are not learned by heart.
PENALTY = 1.0
# Words of fewer toxic documents of the sample than this carry no weight.
LEAST_DOCUMENTS = 3
# Log odds at which the words of a sentence begin to count.
BASE = -6.0
ENDS = b".!?\n"


def _table() -> bytes:
    """Lower-case ASCII; other ASCII signs become spaces."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 0x20
    return bytes(table)


TABLE = _table()
_IS_END = np.zeros(256, bool)
_IS_END[list(ENDS)] = True


@dataclass
class Model:
    """Weights of hashed words, by rising hash, and the leak as a log odds."""

    keys: np.ndarray
    weights: np.ndarray
    leak: float

    def per_item(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], 0.0)


NOTHING_LEARNED = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence, text of sentence, place of sentence in its text).

    ``feature`` and ``sentence`` have one item per word and one more per long word. Sentences end at one of
    ``. ! ?`` or a line break, count from 0 over the batch, and have at least one word.
    """
    whole = words_of(texts, TABLE)
    if not len(whole.start):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    ends = np.flatnonzero(_IS_END[np.frombuffer(whole.buffer, np.uint8)])
    raw = np.searchsorted(ends, whole.start)
    new = np.concatenate(([True], (raw[1:] != raw[:-1]) | (whole.text[1:] != whole.text[:-1])))
    sentence = np.cumsum(new) - 1
    owner = whole.text[new]
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    numbers = np.arange(len(owner))
    place = numbers - np.maximum.accumulate(np.where(first, numbers, 0))
    long = whole.end - whole.start > PREFIX
    start = words_of(texts, TABLE, PREFIX).hash[long] ^ np.uint64(0x5555555555555555)
    return np.concatenate((whole.hash, start)), np.concatenate((sentence, sentence[long])), owner, place


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fitted(
    used: np.ndarray,
    column: np.ndarray,
    sentence: np.ndarray,
    owner: np.ndarray,
    label: np.ndarray,
    weight: np.ndarray,
    rounds: int = ROUNDS,
) -> Model:
    """The sentence model that fits the labels of the texts.

    ``column`` and ``sentence`` pair the features of a sentence, as places in ``used``, with its number; ``owner``
    is the text of a sentence. A sentence's risk is softplus(BASE + weights of its words) - softplus(BASE). With s =
    their sum and the leak's risk, noisy-or is 1 - exp(-s): the loss is s for a clean document and
    -log(1 - exp(-s)) for a toxic one. Gradient rounds with adaptive step sizes; a linear penalty and weights of
    zero or more leave only words that speak for toxicity.
    """
    share = (weight * label).sum() / max(1e-12, weight.sum())
    w = np.zeros(len(used))
    leak = float(np.log(min(max(share, 1e-4), 0.5)))
    w += 0.5  # without any weight no sentence would count
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    total = max(1e-12, weight.sum())
    for t in range(1, rounds + 1):
        z = BASE + np.bincount(sentence, w[column], minlength=len(owner))
        s = np.bincount(owner, _softplus(z) - _softplus(BASE), minlength=len(label)) + _softplus(leak)
        slope = np.where(label > 0, -1.0 / np.maximum(np.expm1(np.minimum(s, 50.0)), 1e-9), 1.0) * weight / total
        dz = slope[owner] / (1.0 + np.exp(-z))
        g = np.append(np.bincount(column, dz[sentence], minlength=len(used)), slope.sum() / (1.0 + np.exp(-leak)))
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        pace = STEP / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        step = pace * m / (1 - 0.9**t)
        w = np.maximum(0.0, w - step[:-1] - pace[:-1] * PENALTY / total)
        leak -= step[-1]
    return Model(used[w > 0], w[w > 0], leak)


def _sampled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, mark, text, toxic) of the chosen documents, written; of texts that share an id the one with the least hash.

    If they have more than SAMPLE_BYTES together, rows are thinned out by the hash of their ids to about that.
    """
    rows = docs.join(chosen, docs["doc_id"] == chosen["_id"]).select("doc_id", "text", "toxic")
    one = F.min(F.struct(F.xxhash64("text").alias("mark"), text_bytes(F.col("text")).alias("text"))).alias("one")
    rows = settled(rows.groupBy("doc_id").agg(one, F.max("toxic").alias("toxic")).select("doc_id", "one.mark", "one.text", "toxic"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held <= SAMPLE_BYTES:
        return rows
    part = F.pmod(F.xxhash64(F.lit("thin"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    return rows.where(part < SAMPLE_BYTES / held)


def _telling(rows: DataFrame) -> np.ndarray:
    """Features of LEAST_DOCUMENTS toxic documents of the sample or more, counted by Spark, in rising order."""

    def distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(features([text])[0]) for text in batch.column(0).to_pylist()]
        every = np.concatenate([np.zeros(0, np.uint64), *found])
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["feature"])

    counted = arrow_pass(rows.where("toxic = 1").select("text"), distinct, "feature bigint").groupBy("feature").count()
    # fewer than a third of the words of a bounded sample
    kept = counted.where(F.col("count") >= LEAST_DOCUMENTS).select("feature").toArrow()
    return np.sort(kept.column(0).to_numpy().astype(np.int64).view(np.uint64))


def learned_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the labelled rows that are not held out; no weights and a tiny leak if there are none.

    A document labelled more than once is toxic if one label says so; null labels and ids are no labels. The sample
    is read in the order of ids, so every run gives the same model.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(hash_share(F.col("doc_id"), MODULUS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, sample / 2 / n) for c, n in sizes.items()}
    if not sizes:
        return NOTHING_LEARNED
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    limit = F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0))
    # about ``sample`` ids; a larger side is joined by shuffle
    chosen = small_side(known.where(part < limit).select(F.col("doc_id").alias("_id"), "toxic"), 2 * sample)
    rows = _sampled(docs, chosen)
    used = _telling(rows)
    if not len(used):
        used = np.zeros(1, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(used)

    def prepared(batch: pa.RecordBatch) -> pa.RecordBatch:
        used = shared.value
        out = [[], [], []]
        for text in batch.column(2).to_pylist():
            feature, sentence, owner, _ = features([text])
            column = np.minimum(np.searchsorted(used, feature), len(used) - 1)
            keep = used[column] == feature
            # a word counts once per sentence
            pair = np.unique(sentence[keep] * len(used) + column[keep])
            out[0].append((pair // len(used)).astype(np.int32).tobytes())
            out[1].append((pair % len(used)).astype(np.int32).tobytes())
            out[2].append(len(owner))
        arrays = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())]
        columns = [batch.column(0), batch.column(1), *arrays, batch.column(3)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "sentence", "feature", "n_sentences", "toxic"])

    def fit(batches):
        sentence, column, counts, label, n = [], [], [], [], 0
        for batch in batches:
            for s, f, count, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                sentence.append(np.frombuffer(s, np.int32) + np.int32(n))
                column.append(np.frombuffer(f, np.int32))
                counts.append(count)
                label.append(y)
                n += count
        model = NOTHING_LEARNED
        if label:
            y = np.array(label, np.float64)
            weight = np.where(y > 0, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
            pairs = []
            for parts in (column, sentence):
                pairs.append(np.concatenate(parts).astype(np.int64))
                parts.clear()
            model = fitted(shared.value, *pairs, np.repeat(np.arange(len(y)), counts), y, weight)
        row = [[model.keys.tobytes()], [model.weights.tobytes()], [model.leak]]
        columns = [pa.array(row[0], pa.binary()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["keys", "weights", "leak"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark bigint, sentence binary, feature binary, n_sentences int, toxic int"
    pairs = arrow_pass(rows.select("doc_id", "mark", "text", "toxic"), prepared, schema)
    # the sample is bounded in rows and bytes, so one task holds it
    ordered = pairs.repartition(1).sortWithinPartitions("doc_id", "mark")
    found = ordered.mapInArrow(fit, "keys binary, weights binary, leak double").first()
    if found is None:  # no chosen document has a text
        return NOTHING_LEARNED
    keys = np.frombuffer(bytes(found["keys"]), np.uint64)
    return Model(keys, np.frombuffer(bytes(found["weights"]), np.float64), found["leak"])


def _probabilities(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(risk per sentence, text, place, probability)."""
    feature, sentence, owner, place = features(texts)
    gain = model.per_item(feature)
    hit = np.flatnonzero(gain)
    # a word counts once per sentence
    order = hit[np.lexsort((feature[hit], sentence[hit]))]
    again = np.zeros(len(order), bool)
    again[1:] = (feature[order][1:] == feature[order][:-1]) & (sentence[order][1:] == sentence[order][:-1])
    order = order[~again]
    risk = _softplus(BASE + np.bincount(sentence[order], gain[order], minlength=len(owner))) - _softplus(BASE)
    return risk, owner, place, -np.expm1(-risk)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_sentences, n_toxic, worst) per row of ``docs``.

    ``score`` is the noisy-or of the sentences and the leak, 0 for null and empty texts; ``n_toxic`` counts sentences of
    probability 0.5 or more, ``worst`` is the place of the most toxic one from 0, null without a sentence.
    Repeated rows score alike; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        score, count, toxic, worst = np.zeros(n), np.zeros(n, int), np.zeros(n, int), np.full(n, -1)
        texts = batch.column(1).to_pylist()
        for rows in slices(texts):
            risk, owner, place, p = _probabilities(texts[rows], shared.value)
            k = rows.stop - rows.start
            found = np.bincount(owner, minlength=k)
            leak = np.where(found > 0, _softplus(shared.value.leak), 0.0)
            score[rows] = -np.expm1(-np.bincount(owner, risk, minlength=k) - leak)
            count[rows] = found
            toxic[rows] = np.bincount(owner, p >= 0.5, minlength=k)
            order = np.lexsort((place, -p, owner))
            top = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))] if len(order) else order
            worst[rows.start + owner[top]] = place[top]
        columns = [
            batch.column(0),
            pa.array(np.clip(score, 0.0, 1.0)),
            pa.array(count.astype(np.int64)),
            pa.array(toxic.astype(np.int64)),
            pa.array(worst.astype(np.int64), mask=worst < 0),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_sentences", "n_toxic", "worst"])

    slim = docs.select("doc_id", text_bytes(F.col("text")).alias("text"))
    return arrow_pass(slim, work, f"doc_id {kind}, score double, n_sentences bigint, n_toxic bigint, worst bigint")


def slices(texts: list[bytes], size: int = 1 << 21):
    """Runs of texts of about ``size`` bytes, so that arrays stay small however large a batch is."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def sentences(text: bytes) -> list[bytes]:
    """The sentences of a text that have a word, in the order in which places count them."""
    cut = text.translate(bytes(0x0A if b in ENDS else b for b in range(256))).split(b"\n")
    return [s.strip() for s in cut if s.translate(TABLE).split()]


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, place, sentence, probability) for every sentence of probability ``least`` or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        row, places, found, chance = [], [], [], []
        for rows in slices(texts):
            _, owner, place, p = _probabilities(texts[rows], shared.value)
            for i in np.flatnonzero(p >= least):
                at = rows.start + int(owner[i])
                row.append(at)
                places.append(int(place[i]))
                found.append(sentences(texts[at])[place[i]].decode("utf-8", "replace"))
                chance.append(float(p[i]))
        columns = [
            batch.column(0).take(pa.array(row, pa.int64())),
            pa.array(places, pa.int64()),
            pa.array(found, pa.string()),
            pa.array(chance, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "sentence", "probability"])

    slim = docs.select("doc_id", text_bytes(F.col("text")).alias("text"))
    return arrow_pass(slim, work, f"doc_id {kind}, place bigint, sentence string, probability double")


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the sentence columns for every row, learned from rows not held out."""
    found = scored(docs, learned_model(docs, labels, sample))
    held_out = hash_share(F.col("doc_id"), MODULUS) == HELD_OUT
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int")
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "n_sentences", "n_toxic", "worst"
    )


__all__ = ["classified", "learned_model", "scored", "offending_sentences", "features", "fitted"]
