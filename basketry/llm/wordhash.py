"""Words of many texts at once as numpy arrays: 64-bit hashes and byte positions.

The texts of an Arrow batch are joined by a line break, so that a word never crosses texts, and hashed
in slices that end at white space. No Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so every power is invertible modulo 2**64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base modulo 2**64; the table grows to the longest word seen."""
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 256), _BASE, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers[:n]


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """hash, start and end byte in ``buffer`` and number of the text, for every word in order."""

    buffer: bytes
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    count: np.ndarray  # words per text


def words_of(texts: list[bytes], table: bytes | None = None, prefix: int = 0) -> Words:
    """Words of ``texts``; ``table`` translates bytes first, ``prefix`` > 0 hashes that many leading bytes only."""
    joined = b"\n".join(texts) + b"\n"
    buffer = joined.translate(table) if table else joined
    data = np.frombuffer(buffer, np.uint8)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        if to < len(data):
            cut = np.flatnonzero(SPACE[data[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
            else:  # one word longer than a slice
                while not SPACE[data[to]]:
                    to += 1
        part = data[at:to]
        solid = ~SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
        if len(edge):
            s, e = edge[0::2], edge[1::2]
            hashes.append(_hashed(part, s, np.minimum(e, s + prefix) if prefix else e))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.searchsorted(np.cumsum(lengths + 1), start, side="right").astype(np.int64)
    return Words(
        joined,
        np.concatenate(hashes) if hashes else none.astype(np.uint64),
        start,
        end,
        text,
        np.bincount(text, minlength=len(texts))[: len(texts)],
    )


def _hashed(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    size = e - s
    first = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (part[np.repeat(s, size) + inside].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inside]
    return mixed_bits(np.add.reduceat(value, first) + size.astype(np.uint64))
