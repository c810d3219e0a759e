"""What a worker remembers of words it has encoded: ids by word, in two generations.

A generation ends when it holds a given number of words or characters. The one before it stays for
lookups, so frequent words pass on and are never encoded twice; what neither generation holds is encoded
in one call for all new words of a run of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Encoder = Callable[[list], tuple[np.ndarray, np.ndarray]]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


def gathered(pool: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``pool[start[r]:start[r + 1]]`` of all rows one after the other, and their sizes."""
    size = np.diff(start)[rows]
    ends = np.cumsum(size)
    inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    return pool[np.repeat(start[rows], size) + inside], size


class WordMemory:
    """``encode`` gives (ids of all words, ids per word) for a list of words; it is asked for new words only."""

    def __init__(self, encode: Encoder, words: int, characters: int):
        self.encode, self.words, self.characters = encode, words, characters
        self._open()
        self.before: tuple[dict, np.ndarray, np.ndarray] = ({}, self.pool, self.start)

    def _open(self) -> None:
        self.numbers = _Numbers()
        self.pool = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)
        self.held = 0

    def ids(self, words: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids per word)."""
        if len(self.numbers) > self.words or self.held > self.characters:
            self.before = (self.numbers, self.pool, self.start)
            self._open()
        rows = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.fresh:
            fresh, self.numbers.fresh = self.numbers.fresh, []
            self._learn(fresh)
        return gathered(self.pool, self.start, rows)

    def _learn(self, fresh: list) -> None:
        numbers, pool, start = self.before
        old = np.fromiter((numbers.get(w, -1) for w in fresh), np.int64, len(fresh))
        known = old >= 0
        sizes = np.zeros(len(fresh), np.int64)
        old_ids, sizes[known] = gathered(pool, start, old[known])
        unknown = [w for w, k in zip(fresh, known.tolist()) if not k]
        new_ids, sizes[~known] = self.encode(unknown) if unknown else (np.zeros(0, np.uint32), sizes[~known])
        merged = np.empty(int(sizes.sum()), np.uint32)
        from_old = np.repeat(known, sizes)
        merged[from_old], merged[~from_old] = old_ids, new_ids
        self.pool = np.concatenate((self.pool, merged))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        self.held += sum(map(len, fresh))
