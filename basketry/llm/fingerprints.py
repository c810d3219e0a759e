"""Document fingerprints that tell how much two versions share: invertible Bloom lookup sketches.

A text is a set of paragraph digests. Its fingerprint is a fixed number of cells, each with a count, the
XOR of the digests and the XOR of their checks; a digest goes to three cells. Subtracting the cells of one
version from those of another cancels what they share, and peeling cells that hold one digest recovers
the digests that differ. If peeling gets stuck, both sketches are built anew with more cells.

The next document is found without a global sort in one task: documents are dealt into parts in id
order, the first document of a part is also sent to the part before (that of the first part to the last),
and each part is read as a stream in order. Texts are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import ordered_parts, text_bytes
from basketry.llm.wordhash import mixed_bits

CELLS = 24
GROWTH = 4
# Cells per digest at which a pair that is still stuck is compared digest by digest.
LAST_RESORT = 4
# Longer paragraphs are cut at sentence ends, and if still longer at words chosen by their hash.
LONG = 400
MOST_WORDS = 64
PAIRS_AT_ONCE = 256
BYTES_AT_ONCE = 1 << 20
_FIRST_ID = -(1 << 63)


def paragraphs(text: bytes) -> list[bytes]:
    """Non-empty lines and sentences of a text; very long ones without an end are cut after some of their
    words, which depends on the words alone, or after MOST_WORDS, so that an edit moves few cuts elsewhere."""
    plain = text.replace(b". ", b".\n").replace(b"! ", b"!\n").replace(b"? ", b"?\n")
    found = []
    for piece in plain.split(b"\n"):
        piece = piece.strip()
        if len(piece) <= LONG:
            if piece:
                found.append(piece)
            continue
        held: list[bytes] = []
        for word in piece.split():
            held.append(word)
            if crc32(word) & 7 == 0 or len(held) == MOST_WORDS:
                found.append(b" ".join(held))
                held = []
        if held:
            found.append(b" ".join(held))
    return found


def digests(text: bytes) -> np.ndarray:
    """64-bit digests of the paragraphs; a repeat counts as another paragraph. Sorted, so order does not matter."""
    hashed = np.array([xxhash.xxh3_64_intdigest(p) for p in paragraphs(text)], np.uint64)
    hashed.sort()
    if len(hashed) < 2:
        return hashed
    new = np.concatenate(([True], hashed[1:] != hashed[:-1]))
    at = np.arange(len(hashed))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(nth > 0, mixed_bits(hashed + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), hashed)


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed_bits(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)


def _places(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """Three cells per digest, one in each third of its owner's cells; other sizes hash anew."""
    third = cells // 3
    rows = []
    for j in range(3):
        salt = np.uint64((cells * 4 + j) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        rows.append((mixed_bits(keys ^ salt) % np.uint64(third)).astype(np.int64) + j * third + owner * cells)
    return np.stack(rows)


class Sketches:
    """Cells of many texts, one row of ``cells`` each."""

    def __init__(self, lists: list[np.ndarray], cells: int):
        self.n, self.cells = len(lists), cells
        keys = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.size = np.array([len(x) for x in lists], np.int64)
        self.count = np.zeros(self.n * cells, np.int64)
        self.keys = np.zeros(self.n * cells, np.uint64)
        self.checks = np.zeros(self.n * cells, np.uint64)
        at = _places(keys, owner, cells).ravel()
        order = np.argsort(at, kind="stable")
        at, keys, checks = at[order], np.tile(keys, 3)[order], np.tile(_check(keys), 3)[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
        if len(at):
            self.count[at[first]] = np.diff(np.append(first, len(at)))
            self.keys[at[first]] = np.bitwise_xor.reduceat(keys, first)
            self.checks[at[first]] = np.bitwise_xor.reduceat(checks, first)

    def text(self, row: int) -> str:
        """One sketch as text: number of digests, then count, digests and checks of the cells."""
        a, b = row * self.cells, (row + 1) * self.cells
        parts = (self.count[a:b].astype("<i4"), self.keys[a:b].astype("<u8"), self.checks[a:b].astype("<u4"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode()


def differing(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number, digests) that differ between a[i] and b[i], by subtracting and peeling; stuck pairs grow.

    A pair that is stuck with LAST_RESORT cells per digest of both, where peeling all but never fails, is
    compared digest by digest.
    """
    found: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(a)
    left = np.arange(len(a))
    while len(left):
        stuck = []
        # pairs side by side keep arrays small
        step = max(1, (1 << 20) // cells)
        for at in range(0, len(left), step):
            group = left[at : at + step]
            one, two = Sketches([a[i] for i in group], cells), Sketches([b[i] for i in group], cells)
            keys, owner, done = _peeled(one, two)
            cuts = np.searchsorted(owner, np.arange(len(group) + 1))
            for k, i in enumerate(group):
                if done[k]:
                    found[i] = keys[cuts[k] : cuts[k + 1]]
                elif cells > LAST_RESORT * (len(a[i]) + len(b[i])):
                    found[i] = np.setxor1d(a[i], b[i])
                else:
                    stuck.append(i)
        left, cells = np.array(stuck, np.int64), cells * GROWTH
    return np.array([len(f) for f in found], np.int64), found


def _peeled(one: Sketches, two: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, row of each in rising order, True per row that was emptied)."""
    cells = one.cells
    count, keys, checks = one.count - two.count, one.keys ^ two.keys, one.checks ^ two.checks
    got_keys, got_owner, got_sign = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # a round empties a cell for good or trusts a wrong digest; it never takes more rounds than cells unless it does
    for _ in range(cells):
        pure = np.flatnonzero(np.abs(count) == 1)
        pure = pure[_check(keys[pure]) == checks[pure]]
        # a sum of digests may look like one, but rarely in one of the three cells that one would have
        pure = pure[(_places(keys[pure], pure // cells, cells) == pure).any(axis=0)]
        if not len(pure):
            break
        order = np.lexsort((keys[pure], pure // cells))
        pure = pure[order]
        new = np.ones(len(pure), bool)
        new[1:] = (keys[pure][1:] != keys[pure][:-1]) | (pure[1:] // cells != pure[:-1] // cells)
        pure = pure[new]
        k, owner, sign = keys[pure], pure // cells, count[pure]
        at = _places(k, owner, cells)
        for j in range(3):
            np.subtract.at(count, at[j], sign)
            np.bitwise_xor.at(keys, at[j], k)
            np.bitwise_xor.at(checks, at[j], _check(k))
        got_keys.append(k)
        got_owner.append(owner)
        got_sign.append(sign)
    found, owner = _net(np.concatenate(got_keys), np.concatenate(got_owner), np.concatenate(got_sign))
    rest = ((count != 0) | (keys != 0) | (checks != 0)).reshape(one.n, cells).any(axis=1)
    return found, owner, ~rest


def _net(keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests by owner; one that was taken out of a sketch and put back again is none."""
    order = np.lexsort((keys, owner))
    keys, owner, sign = keys[order], owner[order], sign[order]
    if not len(keys):
        return keys, owner
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))))
    kept = first[np.add.reduceat(sign, first) != 0]
    return keys[kept], owner[kept]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared digests over all digests of either, from the recovered differences; 1 for two empty texts."""
    differ, _ = differing(a, b)
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    return np.where(total + differ > 0, (total - differ) / np.maximum(total + differ, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the first as many code points of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(ids: list, texts: list[bytes], following: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
    plain = [t.decode(errors="replace") for t in texts]
    changed = [edited(t, n.decode(errors="replace")).encode() for t, n in zip(plain, following)]
    own, new = [digests(t) for t in texts], [digests(t) for t in changed]
    # the following text is mostly the next one here
    known = {id(t): d for t, d in zip(texts, own)}
    after = [known[id(t)] if id(t) in known else digests(t) for t in following]
    first, second = Sketches(own, CELLS), Sketches(new, CELLS)
    columns = [
        pa.array(ids, kind),
        pa.array([len(t) for t in plain], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
        pa.array([first.text(i) for i in range(len(texts))]),
        pa.array([second.text(i) for i in range(len(texts))]),
        pa.array(likeness(own, new)),
        pa.array(likeness(own, after)),
    ]
    return pa.RecordBatch.from_arrays(columns, _COLUMNS)


def with_next_part(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, ahead, doc_id, text) sorted inside partitions so that the next document follows each row of its
    part; rows with ``ahead`` = 1 are the first of the following part (after the last part: of the first)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = ordered_parts(slim, "doc_id", "part").withColumn("at", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST_ID)))
    # one row per part, at most MAX_PARTS
    heads = sorted((r.part, r.first) for r in rows.groupBy("part").agg(F.min("at").alias("first")).collect())
    before = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]
    ahead = F.broadcast(docs.sparkSession.createDataFrame(before, "head bigint, earlier int"))
    both = F.array(F.struct("part", F.lit(0).alias("ahead")), F.struct(F.col("earlier").alias("part"), F.lit(1).alias("ahead")))
    once = F.array(F.struct("part", F.lit(0).alias("ahead")))
    sent = rows.join(ahead, F.col("at") == F.col("head"), "left").select(
        F.explode(F.when(F.col("head").isNull(), once).otherwise(both)).alias("to"),
        "doc_id",
        "at",
        text_bytes(F.col("text")).alias("text"),
        F.xxhash64("text").alias("mark"),
    )
    sent = sent.select("to.part", "to.ahead", "doc_id", "at", "text", "mark")
    return sent.repartition("part").sortWithinPartitions("part", "ahead", "at", "mark")


def versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document has the next id, null ids first; rows that repeat an id are in the order of the hashes of
    their texts. A null text is empty. A single document follows itself. Likeness is 1 for two texts
    without paragraphs and 0 for one. Other columns are not read; an empty table gives an empty table.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, id, text) that waits for its next document
        ids, texts, following, held = [], [], [], 0
        for batch in batches:
            kind_of_id = batch.column(2).type
            for part, ahead, name, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if last is not None and last[0] == part:
                    ids.append(last[1])
                    texts.append(last[2])
                    following.append(body)
                    held += len(last[2])
                last = None if ahead else (part, name, body)
                if len(ids) >= PAIRS_AT_ONCE or held >= BYTES_AT_ONCE:
                    yield _compared(ids, texts, following, kind_of_id)
                    ids, texts, following, held = [], [], [], 0
        if ids:
            yield _compared(ids, texts, following, kind_of_id)

    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return with_next_part(docs, doc_id, text).mapInArrow(run, f"{schema}, near_edited double, near_next double")
