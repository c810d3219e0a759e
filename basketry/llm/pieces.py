"""SentencePiece encoding that keeps, for every piece, the bytes of the source it stands for, and decoding.

A model file holds a normalisation (a character map compiled into a double-array trie, and rules for white
space) and a vocabulary. The map is walked here: at each place of a text its longest key is replaced, and
every byte that comes out remembers the source byte it comes from. The normalised text is cut into pieces
by the model's vocabulary alone; the ends of a piece, looked up in that alignment, are its bytes in the source.

Pieces never reach across the white space mark inside them in the usual vocabularies. Then the parts of a
text that begin with the mark are encoded by themselves and remembered (``WordMemory``); other models see
the normalised text as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import text_bytes
from basketry.llm.memory import WordMemory

# What one generation of a worker's memory holds.
WORDS = 500_000
CHARACTERS = 8_000_000
# Texts are encoded in runs of about this many bytes.
RUN_BYTES = 1 << 21

MARK = "▁"  # stands for a space in normalised text
REPLACEMENT = "�".encode()
# Field numbers of the model file (fixed values of its format).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_KIND = 1, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SUFFIX_MARK = 24
CHARACTER_MAP, DUMMY_PREFIX, FEWER_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _as_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes(out) + bytes([value])


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, raw bytes) of each field of a protocol buffer message."""
    at = 0
    while at < len(message):
        begin = at
        tag, at = _varint(message, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(message, at)
        else:
            if kind == 2:
                size, at = _varint(message, at)
            else:
                size = 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        yield tag >> 3, value, message[begin:at]


class CharacterMap:
    """Longest-prefix lookup in a compiled character map.

    The map is the size of a double-array trie in bytes, the trie as little-endian 32-bit units, and the
    replacements, each ended by a zero byte; a key's value is the place of its replacement.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.texts = compiled[4 + size :]
        self.found: dict[int, bytes] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that ``source`` has at ``at``."""
        units, best = self.units, None
        place = self._offset(units[0])
        for i in range(at, len(source)):
            place ^= source[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != source[i]:
                break
            place ^= self._offset(unit)
            if unit & 256:
                best = (i + 1 - at, units[place] & 0x7FFFFFFF)
        if best is None:
            return None
        size, value = best
        if value not in self.found:
            self.found[value] = self.texts[value : self.texts.index(0, value)]
        return size, self.found[value]


def _width(source: bytes, at: int) -> int:
    """Bytes of the character at ``at``; zero if they are not valid UTF-8."""
    lead = source[at]
    size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    if size == 1:
        return 1
    try:
        source[at : at + size].decode()
    except UnicodeDecodeError:
        return 0
    return size


class Normalizer:
    """Normalised text and its alignment, by the rules of a model file."""

    def __init__(self, spec: bytes, suffix_mark: bool):
        values = {number: value for number, value, _ in _fields(spec)}
        compiled = values.get(CHARACTER_MAP, b"")
        self.map = CharacterMap(compiled) if compiled else None
        self.dummy_prefix = bool(values.get(DUMMY_PREFIX, 1))
        self.fewer_spaces = bool(values.get(FEWER_SPACES, 1))
        self.space = MARK.encode() if values.get(ESCAPE_SPACES, 1) else b" "
        self.suffix_mark = suffix_mark
        self.plain = self.map is None and not self.fewer_spaces and not suffix_mark

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and for the end the source byte its character begins at)."""
        return self._plain(source) if self.plain and source else self._walked(source)

    def _plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        text = source.decode(errors="replace")
        if "�" in text and text.encode() != source:
            return self._walked(source)
        data = np.frombuffer(source, np.uint8)
        begin = np.arange(len(data), dtype=np.int32)
        if not source.isascii():
            begin = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, begin, 0))
        parts = [np.repeat(begin, np.where(data == 32, len(self.space), 1)), np.array([len(data)], np.int32)]
        out = source.replace(b" ", self.space)
        if self.dummy_prefix:
            out = self.space + out
            parts.insert(0, np.zeros(len(self.space), np.int32))
        return out, np.concatenate(parts)

    def _step(self, source: bytes, at: int) -> tuple[int, bytes]:
        """(bytes read, what they become) at one place of the source."""
        found = self.map.longest(source, at) if self.map else None
        if found:
            return found
        size = _width(source, at)
        return (size, source[at : at + size]) if size else (1, REPLACEMENT)

    def _walked(self, source: bytes) -> tuple[bytes, np.ndarray]:
        at, end = 0, len(source)
        if self.fewer_spaces:
            while at < end:
                size, text = self._step(source, at)
                if text != b" ":
                    break
                at += size
        if at == end:
            return b"", np.array([end], np.int32)
        out, align = bytearray(), []

        def put(text: bytes, place: int) -> None:
            out.extend(text)
            align.extend([place] * len(text))

        if self.dummy_prefix and not self.suffix_mark:
            put(self.space, at)
        after_space = self.fewer_spaces
        while at < end:
            size, text = self._step(source, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", self.space), at)
                after_space = self.fewer_spaces and text.endswith(b" ")
            elif not self.fewer_spaces:
                after_space = False
            at += size
        if self.fewer_spaces:
            while out.endswith(self.space):
                end = align[-len(self.space)]
                del out[-len(self.space) :], align[-len(self.space) :]
        if self.dummy_prefix and self.suffix_mark:
            put(self.space, end)
        return bytes(out), np.array([*align, end], np.int32)


class PieceCoder:
    """Ids, source spans and texts by a model file whose vocabulary has all single bytes.

    Without them a character that the vocabulary lacks would have no piece of a known length; such models
    are refused.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        pieces, trainer, spec, rest = [], {}, b"", []
        for number, value, raw in _fields(model):
            if number == PIECES:
                piece = {n: v for n, v, _ in _fields(value)}
                pieces.append((piece.get(PIECE_TEXT, b""), piece.get(PIECE_KIND, NORMAL)))
            if number == TRAINER:
                trainer = {n: v for n, v, _ in _fields(value)}
            if number == NORMALIZER:
                spec = value
            else:
                rest.append(raw)
        kinds = [kind for _, kind in pieces]
        if kinds.count(BYTE) != 256:
            raise ValueError("the model has no pieces for single bytes")
        self.library = SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(spec, bool(trainer.get(SUFFIX_MARK, 0)))
        # the same vocabulary for text that is normalised already
        as_is = b"".join(bytes([number << 3, 0]) for number in (DUMMY_PREFIX, FEWER_SPACES))
        if self.normalize.space == b" ":
            as_is += bytes([ESCAPE_SPACES << 3, 0])
        stage = bytes([NORMALIZER << 3 | 2]) + _as_varint(len(as_is)) + as_is
        self.vocabulary = SentencePieceProcessor(model_proto=b"".join(rest) + stage)
        self.begin_id, self.end_id = self.library.bos_id(), self.library.eos_id()
        self.size = np.array([1 if kind == BYTE else 0 if kind == CONTROL else len(text) for text, kind in pieces], np.int64)
        space = self.normalize.space.decode()
        inside = re.compile(f"[^{space}]{space}")
        self.by_word = not self.normalize.suffix_mark and not any(
            inside.search(text.decode()) for text, kind in pieces if kind not in (CONTROL, UNKNOWN, BYTE)
        )
        self.word = re.compile(f"{space}*[^{space}]+|{space}+")
        self.memory = WordMemory(self._learn, WORDS, CHARACTERS)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.vocabulary.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first source byte, end in the source) per text, with begin and end ids."""
        aligned = [self.normalize(t) for t in texts]
        normal = [out.decode() for out, _ in aligned]
        parts = [self.word.findall(t) if self.by_word else [t] for t in normal]
        words = [w for p in parts for w in p]
        ids, sizes = self.memory.ids(words) if self.by_word else self._learn(words)
        per_word = np.concatenate(([0], np.cumsum(sizes)))
        ends = per_word[np.cumsum([len(p) for p in parts])] if parts else []
        results, at = [], 0
        for source, (_, align), end in zip(texts, aligned, ends):
            own = ids[at:end]
            stop = np.cumsum(self.size[own])
            first, last = align[stop - self.size[own]], align[stop]
            results.append(
                (
                    np.concatenate(([self.begin_id], own, [self.end_id])).astype("<u4"),
                    np.concatenate(([0], first, [len(source)])).astype("<u4"),
                    np.concatenate(([0], last, [len(source)])).astype("<u4"),
                )
            )
            at = end
        return results

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_coders: dict[str, PieceCoder] = {}


def coder_at(path: str) -> PieceCoder:
    """The coder of this worker; its memory of words lasts over tasks."""
    if path not in _coders:
        with open(path, "rb") as f:
            _coders[path] = PieceCoder(f.read())
    return _coders[path]


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose values of a binary column have about RUN_BYTES; at least one row each."""
    values = batch.column(column)
    sizes = pa.compute.binary_length(values).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a), values.slice(a, b - a).to_pylist()


def encoded(docs: DataFrame, model: str, decode: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends) for each row of ``docs`` (doc_id, text), and ``decoded`` if asked for.

    ``ids`` are little-endian unsigned 32-bit integers as bytes, begin and end id included; ``begins`` and
    ``ends``, in the same form, are the bytes of the UTF-8 source that each piece stands for. The marks have
    empty spans at the two ends. Of the byte pieces of one character the last has its span, those before are empty.
    A null or empty text gives the two marks alone. Every row gives one row, also rows that repeat an id
    or have none; other columns are not read. ``model`` is a file every worker has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_at(model)
        for batch in batches:
            for part, texts in _runs(batch, 1):
                found = coder.encode(texts)
                columns = [part.column(0), pa.array([len(f[0]) for f in found], pa.int64())]
                columns += [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(3)]
                if decode:
                    columns.append(pa.array([coder.decode(f[0]) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids", "begins", "ends"] + ["decoded"] * decode
    schema = "doc_id bigint, n_tokens bigint, ids binary, begins binary, ends binary" + ", decoded string" * decode
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, decoded): the texts of stored ids (doc_id, ids as in ``encoded``); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_at(model)
        for batch in batches:
            for part, ids in _runs(batch, 1):
                texts = [coder.decode(np.frombuffer(i, "<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    ids = F.coalesce(F.col("ids"), F.lit(b"")).alias("ids")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), ids).mapInArrow(run, "doc_id bigint, decoded string")


def piece_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, place, id, begin, end) per piece of the rows of ``encoded``, places from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids in _runs(batch, 1):
                counts = [len(i) // 4 for i in ids]
                flat = [np.frombuffer(b"".join(part.column(k).to_pylist()), "<u4").astype(np.int64) for k in (1, 2, 3)]
                doc = part.column(0).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
                place = np.concatenate([np.arange(n) for n in counts])
                columns = [doc, *map(pa.array, (place, *flat))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "id", "begin", "end"])

    picked = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids", "begins", "ends")
    return picked.mapInArrow(run, "doc_id bigint, place bigint, id bigint, begin bigint, end bigint")
