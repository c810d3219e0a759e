"""Locally consistent parsing of word sequences by recompression, as numpy arrays.

Round 0 replaces every run of equal words by one symbol. Each later round deals all symbols into left and
right ones by a bit of their names and replaces every left symbol followed by a right one by a pair
symbol. A name is a 64-bit hash of what the symbol stands for, so equal runs and pairs have equal
names in every document and every task; no table of names has to be kept or sent.

Which pairs form depends on the two symbols alone. Equal word sequences are therefore parsed alike
but for a few symbols at either end, whose neighbours outside may differ. For every window of
SPAN words the interior symbols, those that are the same wherever the window occurs, follow from its own
words: at each round the first one is given up if it is a right symbol (it may join what stands
before) and the last one if it is a left symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from basketry.llm.wordhash import mixed_bits

SPAN = 50
ROUNDS = 6
_FIRST, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_ROUND = 0x9E3779B97F4A7C15


def _salt(level: int) -> np.uint64:
    return np.uint64(_ROUND * (level + 1) & (1 << 64) - 1)


@dataclass
class Anchors:
    """Per group of consecutive windows: text, first and last start (words of the batch), name, and its level."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    name: np.ndarray
    level: np.ndarray


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) <= n:
        for key, base in (("up", _ROUND), ("down", pow(_ROUND, -1, 1 << 64))):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _tables[key] = np.cumprod(table, dtype=np.uint64)
    return _tables["up"], _tables["down"]


class Sums:
    """Hashes of any stretch of a sequence, from running sums of its items times powers of an odd base modulo 2**64."""

    def __init__(self, items: np.ndarray):
        up, self.down = _power_tables(len(items))
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * up[: len(items)], dtype=np.uint64, out=self.sums[1:])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One hash per stretch from a to b, b left out; it does not depend on where the stretch stands."""
        return (self.sums[b] - self.sums[a]) * self.down[a]


def _longest(symbol: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per range from low to high, high left out, the symbol of most words; of equally long ones that with the largest mark."""
    size = np.minimum(np.diff(begin), (1 << 15) - 1).astype(np.uint64)
    rank = (size << np.uint64(48)) | (mixed_bits(symbol) >> np.uint64(16))
    width = high - low
    found = np.zeros(len(low), np.int64)
    numbers = np.arange(len(symbol))
    best = numbers
    step = 1
    while True:
        pick = np.flatnonzero((width >= step) & (width < 2 * step))
        if len(pick):
            a, b = best[low[pick]], best[high[pick] - step]
            found[pick] = np.where(rank[a] >= rank[b], a, b)
        if step * 2 > width.max():
            return found
        other = best[np.minimum(numbers + step, len(symbol) - 1)]
        best = np.where(rank[best] >= rank[other], best, other)
        step *= 2


def anchors(name: np.ndarray, text: np.ndarray, span: int = SPAN, rounds: int = ROUNDS) -> Anchors:
    """One interior symbol of every window of ``span`` words, windows grouped by the occurrence of the symbol.

    A window takes the longest symbol of the last round in which it has an interior, so that neighbouring
    windows mostly take the same one. ``name`` and ``text`` are the hash and the text of every word of a batch, in
    order. Windows without an interior symbol (inside long runs) have level -1 and name 0, one group each.
    """
    n = len(name)
    starts = np.flatnonzero(text[: n - span + 1] == text[span - 1 :]) if n >= span else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none, none.astype(np.uint64), none)
    # round 0: runs
    head = np.ones(n, bool)
    head[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, n))
    at = np.cumsum(head) - 1
    symbol, owner = name[begin], text[begin]
    symbol = np.where(size > 1, mixed_bits(symbol * _FIRST + size.astype(np.uint64) * _SECOND), symbol)
    low = at[starts] + 1  # the run of the first word may start outside
    high = at[starts + span - 1]  # and that of the last may go on
    best, level = np.zeros(len(starts), np.uint64), np.full(len(starts), -1)
    place = starts.copy()
    begin = np.append(begin, n)
    for r in range(rounds + 1):
        good = low < high
        if not good.any():
            break
        here = (symbol, begin, low, high)
        if r < rounds:
            right = (mixed_bits(symbol ^ _salt(r)) & np.uint64(1)).astype(bool)
            joined = np.zeros(len(symbol), bool)  # the symbol is the right one of a pair
            joined[1:] = ~right[:-1] & right[1:] & (owner[1:] == owner[:-1])
            number = np.append(np.cumsum(~joined) - 1, len(symbol) - np.count_nonzero(joined))
            side = np.append(right, False)
            low = number[np.where(good, low + side[low], low)]
            high = number[np.where(good, high - ~side[np.maximum(high - 1, 0)], high)]
            left = np.flatnonzero(joined) - 1
            symbol = symbol.copy()
            symbol[left] = mixed_bits(symbol[left] * _FIRST + symbol[left + 1] * _SECOND + _salt(r))
            symbol, owner, begin = symbol[~joined], owner[~joined], np.append(begin[:-1][~joined], n)
            done = np.flatnonzero(good & (low >= high))
        else:
            done = np.flatnonzero(good)
        if len(done):
            top = _longest(here[0], here[1], here[2][done], here[3][done])
            best[done], level[done], place[done] = mixed_bits(here[0][top] + _salt(r)), r, here[1][top]
    new = np.ones(len(starts), bool)
    new[1:] = (
        (level[1:] < 0)
        | (level[1:] != level[:-1])
        | (place[1:] != place[:-1])
        | (starts[1:] != starts[:-1] + 1)
    )
    i = np.flatnonzero(new)
    last = starts[np.append(i[1:], len(starts)) - 1]
    return Anchors(text[starts[i]], starts[i], last, best[i], level[i])
