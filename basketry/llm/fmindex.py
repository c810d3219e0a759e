"""A bidirectional FM-index over a delimited list of words, and search schemes for one error, in numpy.

The text is ``|word|word|...|`` in numbered symbols: 0 the end of the text, 1 the delimiter, then the letters.
Symbols and their ranks are kept for the text and for its reverse, so that the suffix-rank interval
of a pattern can grow by a symbol on either side while the interval in the other text keeps step.

A pattern is cut in two. With one error at least one half occurs as it is: the first scheme matches the left
half from the delimiter on and goes on to the right, the second matches the right half up to the delimiter and
goes on to the left, both allowing one insertion, deletion or replacement where they go on. Of equivalent places for
an error only the rightmost counts, so every pair is found once. All patterns advance together, one
symbol a step.
"""

from __future__ import annotations

import numpy as np

END, DELIMITER, FIRST_LETTER = 0, 1, 2
# Patterns searched at a time.
PATTERNS = 1 << 14


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Places of the suffixes of ``text`` in order, the empty one first; ranks of doubled length until all differ."""
    n = len(text) + 1
    bits = max(1, int(symbols).bit_length())
    width = 62 // bits
    padded = np.concatenate((text.astype(np.int64), np.zeros(width + 1, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << bits | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([False], key[order][1:] != key[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        width *= 2


class Side:
    """Symbol ranks of one text: ``ranks[i, c]`` symbols ``c`` stand before place ``i`` of its transform."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_order(text, symbols)
        transform = np.where(self.order > 0, text[self.order - 1], END)
        self.ranks = np.zeros((len(transform) + 1, symbols), np.int32)
        self.ranks[np.arange(1, len(transform) + 1), transform] = 1
        np.cumsum(self.ranks, axis=0, out=self.ranks)
        self.first = np.concatenate(([0], np.cumsum(self.ranks[-1])[:-1])).astype(np.int64)


class Index:
    """The index of a list of different words that are not empty."""

    def __init__(self, words: list[str]):
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(letters)
        self.symbols = len(self.alphabet) + FIRST_LETTER
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.full(len(letters) + len(words) + 1, DELIMITER, np.int64)
        at = np.arange(len(letters)) + np.repeat(np.arange(len(words)), lengths) + 1
        text[at] = np.searchsorted(self.alphabet, letters) + FIRST_LETTER
        self.delimiters = np.cumsum(text == DELIMITER)
        self.forward, self.backward = Side(text, self.symbols), Side(text[::-1], self.symbols)

    def coded(self, patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all patterns, lengths); a letter that no word has is the symbol after the last."""
        letters = np.frombuffer("".join(patterns).encode("utf-32-le"), np.uint32)
        code = np.searchsorted(self.alphabet, letters)
        known = self.alphabet[np.minimum(code, len(self.alphabet) - 1)] == letters
        lengths = np.fromiter(map(len, patterns), np.int64, len(patterns))
        return np.where(known, code + FIRST_LETTER, self.symbols), lengths

    def right(self, low: np.ndarray, back: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both intervals after one more symbol on the right: (low, low in the reverse, size)."""
        before = self.backward.ranks[back]
        inside = self.backward.ranks[back + size] - before
        known = symbol < self.symbols
        symbol = np.minimum(symbol, self.symbols - 1)
        line = np.arange(len(symbol))
        smaller = np.where(np.arange(self.symbols) < symbol[:, None], inside, 0).sum(1)
        return low + smaller, self.backward.first[symbol] + before[line, symbol], np.where(known, inside[line, symbol], 0)

    def near(self, patterns: list[str], left_half_exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) of all pairs one error apart whose error the scheme allows; see the module."""
        found = [(np.zeros(0, np.int64),) * 2]
        for a in range(0, len(patterns), PATTERNS):
            pattern, word = _Scheme(self, patterns[a : a + PATTERNS], left_half_exact).run()
            found.append((pattern + a, word))
        return tuple(np.concatenate(x) for x in zip(*found))


class _Scheme:
    def __init__(self, index: Index, patterns: list[str], left_half_exact: bool):
        self.index, self.onward = index, left_half_exact
        self.codes, self.length = index.coded(patterns)
        self.start = np.cumsum(self.length) - self.length
        self.half = self.length // 2
        # past the exact half only one side is followed: its ranks and first places
        self.side = index.backward if left_half_exact else index.forward

    def _letter(self, pattern: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The symbol at a place of a pattern; the delimiter before and after it."""
        inside = (place >= 0) & (place < self.length[pattern])
        if not len(self.codes):
            return np.full(len(pattern), DELIMITER)
        at = np.where(inside, self.start[pattern] + place, 0)
        return np.where(inside, self.codes[at], DELIMITER)

    def _exact_half(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low on the side that goes on, size) after the exact half with its delimiter."""
        pattern = np.arange(len(self.length))
        begin = np.full(len(pattern), -1) if self.onward else self.half.copy()
        stop = self.half if self.onward else self.length + 1
        low = back = np.zeros(len(pattern), np.int64)
        size = np.full(len(pattern), len(self.index.forward.order), np.int64)
        done = []
        place = begin
        while len(pattern):
            ended = place == stop[pattern]
            done.append((pattern[ended], (back if self.onward else low)[ended], size[ended]))
            pattern, place, low, back, size = (x[~ended] for x in (pattern, place, low, back, size))
            if not len(pattern):
                break
            low, back, size = self.index.right(low, back, size, self._letter(pattern, place))
            alive = size > 0
            pattern, place, low, back, size = (x[alive] for x in (pattern, place + 1, low, back, size))
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (pattern, low, size)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        index, ranks, first = self.index, self.side.ranks, self.side.first
        none = np.zeros(0, np.int64)
        pattern, low, size = self._exact_half()
        # the next place of the pattern to match, going right or left
        move = 1 if self.onward else -1
        place = self.half[pattern] if self.onward else self.half[pattern] - 1
        wrong = [none] * 4  # states with their error behind them: pattern, next place, low, size
        found = [(none, none)]
        while len(pattern) or len(wrong[0]):
            after = []
            if len(wrong[0]):
                who, at, lo, n = wrong
                symbol = self._letter(who, at)
                known = symbol < index.symbols
                symbol = np.minimum(symbol, index.symbols - 1)
                begin, end = ranks[lo, symbol], ranks[lo + n, symbol]
                alive = known & (end > begin)
                who, at, symbol = who[alive], at[alive], symbol[alive]
                lo, n = first[symbol] + begin[alive], (end - begin)[alive].astype(np.int64)
                whole = symbol == DELIMITER
                found.append((who[whole], lo[whole]))
                after.append((who[~whole], at[~whole] + move, lo[~whole], n[~whole]))
            if len(pattern):
                before = ranks[low]
                inside = ranks[low + size] - before
                symbol = self._letter(pattern, place)
                within = symbol != DELIMITER
                line, letter = np.nonzero(inside[:, FIRST_LETTER:])
                letter += FIRST_LETTER
                grown = (first[letter] + before[line, letter], inside[line, letter].astype(np.int64))
                replaced = within[line] & (letter != symbol[line])
                after.append((pattern[line][replaced], place[line][replaced] + move, *(x[replaced] for x in grown)))
                # a letter too many goes before the next place to the right, unless that has the same letter
                to_right = symbol if self.onward else self._letter(pattern, place + 1)
                inserted = letter != to_right[line]
                if not self.onward:  # the gap between the halves belongs to the other scheme
                    inserted &= (place + 1 < self.half[pattern])[line]
                after.append((pattern[line][inserted], place[line][inserted], *(x[inserted] for x in grown)))
                # of equal letters in a row the last one is the missing one
                missing = within & (self._letter(pattern, place + 1) != symbol)
                after.append((pattern[missing], place[missing] + move, low[missing], size[missing]))
                known = within & (symbol < index.symbols)
                pattern, place, symbol, before, inside = (x[known] for x in (pattern, place, symbol, before, inside))
                each = np.arange(len(pattern))
                size = inside[each, symbol].astype(np.int64)
                low = first[symbol] + before[each, symbol]
                alive = size > 0
                pattern, place, low, size = (x[alive] for x in (pattern, place + move, low, size))
            wrong = [np.concatenate(x) for x in zip(*after)]
        who, lo = (np.concatenate(x) for x in zip(*found))
        place = self.side.order[lo]
        if self.onward:  # the reverse text begins with the delimiter after the word
            return who, index.delimiters[len(index.delimiters) - 1 - place] - 2
        return who, index.delimiters[place] - 1
