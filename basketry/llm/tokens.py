"""Token ids as flat binary files with document offsets.

Documents are cut into parts in id order. Each part becomes a shard of three files: ``.bin`` holds its
ids as unsigned integers (two bytes if the vocabulary allows, else four), ``.off`` the 64-bit offsets
of its documents in the whole corpus and one more for the end, ``.doc`` their ids. Shards are written by
the tasks that tokenise; how many ids the parts before hold is a prefix sum over the parts, known only
then, so offsets follow in a second, light pass. ``manifest.json`` lists the shards.

Files are written under a name of the attempt and renamed at the end, so that a task that runs
twice leaves one whole file. Any file system that pyarrow can open will do; local ones are memory-mapped.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.llm.common import cut_lineage, ordered_parts, text_bytes
from basketry.llm.memory import WordMemory

END_ID = 2
# What one generation of a worker's memory holds (see ``memory``).
CACHE_WORDS = 600_000
CACHE_BYTES = 16_000_000
# Texts are tokenised in runs of about this many bytes.
RUN_BYTES = 1 << 22


class WordTokens:
    """Ids of texts by a tokenizer, remembered word by word.

    Only for tokenizers whose ids do not depend on what stands beyond white space; for others every text
    is encoded as it is. Strings of special tokens are ordinary text here; see ``TextTokens``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = splits_at_space(json.loads(self.tokenizer.to_str()))
        self.memory = WordMemory(self._learn, CACHE_WORDS, CACHE_BYTES)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text), without end marks."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False)
            ids = [np.array(e.ids, np.uint32) for e in found]
            return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.array([len(i) for i in ids], np.int64)
        split = [t.split() for t in texts]  # bytes: splits at ASCII white space only
        ids, size = self.memory.ids(list(itertools.chain.from_iterable(split)))
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(ends)

    def _learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new words in lines of many; the offsets of the ids tell which word they belong to."""
        pools, sizes = [], []
        for at in range(0, len(fresh), 2000):
            found = [w.decode(errors="replace") for w in fresh[at : at + 2000]]
            encoded = self.tokenizer.encode(" ".join(found), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in found[:-1]])
            place = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.ids))
            word = np.searchsorted(starts, place, side="right") - 1
            pools.append(np.array(encoded.ids, np.uint32))
            sizes.append(np.bincount(word, minlength=len(found)))
        return np.concatenate(pools), np.concatenate(sizes)


class TextTokens(WordTokens):
    """Ids as the library gives them with ``add_special_tokens=False``: the string of a special token in a text is
    that token. Texts that hold the string of an added token are encoded whole, the others word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        added = sorted(self.whole.get_added_tokens_decoder().values(), key=lambda t: t.content)
        # tokens sought in the normalized text can look different in the text itself: no cache then
        self.by_word = self.by_word and not any(t.normalized for t in added)
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in added)) if added else None

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.whole.encode_batch_fast([t.decode(errors="replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            special = list(range(len(texts)))
        else:
            special = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
            if not special:
                return super().encode(texts)
        pieces: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(special, self._whole([texts[i] for i in special])):
            pieces[i] = ids
        rest = sorted(set(range(len(texts))) - set(special))
        if rest:
            ids, counts = super().encode([texts[i] for i in rest])
            for i, part in zip(rest, np.split(ids, np.cumsum(counts)[:-1])):
                pieces[i] = part
        return np.concatenate([np.zeros(0, np.uint32), *pieces]), np.array([len(p) for p in pieces], np.int64)


def splits_at_space(spec: dict) -> bool:
    """True if a tokenizer drops white space first, so that every word is encoded by itself."""
    step = spec.get("pre_tokenizer") or {}
    if step.get("type") == "Sequence":
        step = (step.get("pretokenizers") or [{}])[0]
    if step.get("type") in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer"):
        kept = True
    elif step.get("type") == "Split":
        # the pattern names what is kept, in pieces that hold no white space
        pattern = step.get("pattern", {}).get("Regex", "")
        kept = bool(step.get("invert")) and step.get("behavior") == "Removed" and " " not in pattern and "\\s" not in (
            pattern.replace("[^\\s", "")
        )
    else:
        kept = False
    normal = spec.get("normalizer") or {}
    steps = normal.get("normalizers", [normal]) if normal else []
    plain = {"NFC", "NFD", "Lowercase", "Replace", "BertNormalizer", "StripAccents"}
    return kept and all(s.get("type") in plain for s in steps) and all(
        s.get("content") == " " for s in steps if s.get("type") == "Replace"
    )


_tokenizers: dict[str, TextTokens] = {}


def tokenizer_at(path: str) -> TextTokens:
    """The tokenizer of this worker; its memory of words lasts over tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = TextTokens(path)
    return _tokenizers[path]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _local(uri: str) -> str:
    """``file:/x`` and ``file:///x`` as Hadoop and pyarrow both take them."""
    return "file://" + uri[5:].lstrip("/").join(["/", ""]) if uri.startswith("file:") else uri


def _put(system: fs.FileSystem, path: str, pieces: Iterator[bytes]) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        for piece in pieces:
            out.write(piece)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
    system.move(temporary, path)


def _array(system: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int | None = None, end_id: int = END_ID) -> dict:
    """Tokenise ``docs`` (doc_id, text) into ``folder``, a URI every executor reaches; the manifest is returned.

    Documents are in id order, null ids first, rows that repeat an id in the order of their texts' hashes.
    A null or empty text is its end mark alone. Other columns are not read. An empty table gives no shard.
    """
    folder = _local(folder.rstrip("/"))
    if vocabulary is None:
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    rows = ordered_parts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", "part")
    rows = rows.select("part", "doc_id", text_bytes(F.col("text")).alias("text"), F.xxhash64("text").alias("mark"))
    dealt = rows.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "mark")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write the ids of each part as they come; give sizes per part, and ids and lengths as bytes."""
        coder = tokenizer_at(tokenizer)
        out, part, held, ids_file = None, None, [], ""
        system, root = _open(folder)

        def closed() -> pa.RecordBatch:
            out.close()
            path = f"{root}/part-{part:06d}"
            if system.get_file_info(f"{path}.bin").type != fs.FileType.NotFound:
                system.delete_file(f"{path}.bin")
            system.move(ids_file, f"{path}.bin")
            doc = np.concatenate([h[0] for h in held])
            size = np.concatenate([h[1] for h in held])
            nulls = sum(h[2] for h in held)
            _put(system, f"{path}.doc", iter([doc.astype("<i8").tobytes()]))
            _put(system, f"{path}.len", iter([size.astype("<u8").tobytes()]))
            data = [[part], [len(doc)], [int(size.sum())], [nulls]]
            return pa.RecordBatch.from_arrays(
                [pa.array(data[0], pa.int32()), *(pa.array(d, pa.int64()) for d in data[1:])],
                ["part", "n_docs", "n_tokens", "n_nulls"],
            )

        for batch in batches:
            parts = batch.column(0).to_numpy()
            texts = batch.column(2).to_pylist()
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                if part is not None and parts[a] != part:
                    yield closed()
                    out = None
                if out is None:
                    part, held = int(parts[a]), []
                    ids_file = f"{root}/part-{part:06d}.bin.{uuid.uuid4().hex}"
                    out = system.open_output_stream(ids_file)
                at = a
                while at < b:
                    to, size = at, 0
                    while to < b and (to == at or size + len(texts[to]) <= RUN_BYTES):
                        size += len(texts[to])
                        to += 1
                    ids, counts = coder.encode(texts[at:to])
                    ends = np.cumsum(counts)
                    out.write(np.insert(ids, ends, end_id).astype(kind).tobytes())
                    names = batch.column(1).slice(at, to - at)
                    held.append((names.fill_null(0).to_numpy(zero_copy_only=False), counts + 1, names.null_count))
                    at = to
        if out is not None:
            yield closed()

    sizes = dealt.mapInArrow(tokenise, "part int, n_docs bigint, n_tokens bigint, n_nulls bigint")
    # one row per part, at most MAX_PARTS; written once, so files are not written again later
    shards = [r.asDict() for r in cut_lineage(sizes).orderBy("part").collect()]
    base = 0
    for shard in shards:
        shard["base"] = base
        base += shard["n_tokens"]
    _write_offsets(docs.sparkSession, folder, shards)
    manifest = {"dtype": kind, "end_id": end_id, "n_tokens": base, "shards": shards}
    _put(system, f"{root}/manifest.json", iter([json.dumps(manifest).encode()]))
    return manifest


def _shard_rows(spark: SparkSession, shards: list[dict]) -> DataFrame:
    rows = spark.createDataFrame([(s["part"], s["base"], s["n_nulls"]) for s in shards], "part int, base bigint, n_nulls bigint")
    return rows.repartition(max(1, min(len(shards), 4 * spark.sparkContext.defaultParallelism)), "part")


def _write_offsets(spark: SparkSession, folder: str, shards: list[dict]) -> None:
    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/part-{part:06d}"
                size = _array(system, f"{path}.len", "<u8")
                ends = np.concatenate((np.zeros(1, np.uint64), np.cumsum(size, dtype=np.uint64))) + np.uint64(base)
                _put(system, f"{path}.off", iter([ends.astype("<u8").tobytes()]))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["part"])

    if shards:
        _shard_rows(spark, shards).mapInArrow(offsets, "part int").foreach(lambda _: None)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, all from the files in ``folder``.

    ``start`` counts the ids of all documents before; the checksum is that of the ids as little-endian
    unsigned 32-bit integers, end mark included.
    """
    folder = _local(folder.rstrip("/"))
    system, root = _open(folder)
    with system.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for part, base, nulls in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/part-{part:06d}"
                ids, doc = _array(system, f"{path}.bin", kind), _array(system, f"{path}.doc", "<i8")
                ends = _array(system, f"{path}.off", "<u8").astype(np.int64)
                for at in range(0, len(doc), 10_000):
                    to = min(len(doc), at + 10_000)
                    cut = ends[at : to + 1] - base
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    columns = [
                        pa.array(np.array(doc[at:to]), mask=np.arange(at, to) < nulls),
                        pa.array(ends[at:to]),
                        pa.array(np.diff(ends[at : to + 1])),
                        pa.array(crc, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)
    return _shard_rows(spark, manifest["shards"]).mapInArrow(read, schema)
