"""A compressed FM-index over a collection of short word sequences.

The Burrows-Wheeler transform of the collection (every sequence ends with its own terminator) is kept as a
wavelet matrix: one packed bit vector with a rank directory per bit of the alphabet. Text and suffix array
are dropped once it is built: what is kept of the order is a bit per suffix that says where the groups of equal
``window``-word beginnings start, and one number per group, the least place of its members.

Patterns are streamed from their last word to their first, all at once, one numpy step per word. The state of
a pattern is the suffix range of the longest match that starts at its present word (its matching statistic):
a word in front extends it by one step of backward search; where that empties the range, the match is
shortened from behind to its parent interval until the word fits.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector of 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray) -> None:
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = ((now >> level) & 1).astype(np.uint8)
            zeros = now[bits == 0]
            self.levels.append((Bits(bits), len(zeros)))
            now = np.concatenate([zeros, now[bits == 1]])
        # where each symbol's run begins on the last level
        self.begin = np.searchsorted(now, np.arange(1 << self.depth), "left") if self._sorted(now) else self._begins()

    @staticmethod
    def _sorted(x: np.ndarray) -> bool:
        return bool((x[1:] >= x[:-1]).all())

    def _begins(self) -> np.ndarray:
        every = np.arange(1 << self.depth)
        return self._walk(every, np.zeros(len(every), np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def occurrences(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._walk(symbol, at) - self.begin[symbol]


def suffix_array(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, longest common prefix of each suffix with the one before it) by prefix doubling; ``ranks`` are
    the symbols, terminators being distinct. The ranks of each doubling also compare prefixes of that size."""
    n, step = len(ranks), 1
    levels = [ranks]
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = ranks[step:] + 1
        key = ranks * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        ranks = np.empty(n, np.int64)
        ranks[order] = fresh
        if fresh[-1] == n - 1:
            break
        levels.append(ranks)
        step *= 2
    common = np.zeros(n, np.int32)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(left, right) < n)
        same = inside[levels[k][left[inside]] == levels[k][right[inside]]]
        left[same] += 1 << k
        right[same] += 1 << k
        common[same + 1] += 1 << k
    return order, common


class FMIndex:
    """Index of ``words`` (64-bit word hashes of all sequences on end) with ``lengths`` of the sequences.

    ``places`` (one number per word, equal for equal places, ``NOWHERE`` where no window begins) say where in
    the corpus a window of ``window`` words starts; a search answers with the least place of its window."""

    NOWHERE = np.iinfo(np.int64).max

    def __init__(self, words: np.ndarray, lengths: np.ndarray, places: np.ndarray, window: int) -> None:
        count, self.window = len(lengths), window
        self.known, ids = np.unique(words, return_inverse=True)
        total = len(words) + count
        ends = np.cumsum(lengths + 1) - 1
        inside = np.ones(total, bool)
        inside[ends] = False
        text = np.zeros(total, np.int64)  # 0: terminator
        text[inside] = ids.reshape(-1) + 1
        ranks = text + count - 1
        ranks[ends] = np.arange(count)
        _, dense = np.unique(ranks, return_inverse=True)
        order, self.common = suffix_array(dense.reshape(-1).astype(np.int64))
        self.wavelet = WaveletMatrix(text[order - 1])  # order 0 wraps to the last terminator
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.known) + 1))))
        self.size = total
        place = np.full(total, self.NOWHERE, np.int64)
        place[inside] = places
        new = self.common < window
        new[0] = True
        self.groups = Bits(new.astype(np.uint8))
        self.earliest = np.minimum.reduceat(place[order], np.flatnonzero(new))
        self._minima: list[np.ndarray] | None = None

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for those the index does not hold."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, at + 1, -1)

    def _extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.occurrences(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.first[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def _parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next wider interval of suffixes with a common prefix, and that prefix' length."""
        if self._minima is None:  # minima of runs of 1, 2, 4 ... common prefixes; only ever built by a failed step
            self._minima = [self.common]
            while 2 * (1 << len(self._minima) - 1) < self.size:
                last, width = self._minima[-1], 1 << len(self._minima) - 1
                self._minima.append(np.minimum(last[: len(last) - width], last[width:]))
        before = self.common[low]
        behind = np.where(high < self.size, self.common[np.minimum(high, self.size - 1)], 0)
        depth = np.maximum(before, behind)
        low, high = low.copy(), high.copy()
        for k in range(len(self._minima) - 1, -1, -1):
            width, table = 1 << k, self._minima[k]
            start = low - width + 1  # rows start..low all share the depth with the row before them
            go = np.flatnonzero((start > 0) & (table[np.clip(start, 0, len(table) - 1)] >= depth))
            low[go] -= width
            go = np.flatnonzero((high + width <= self.size) & (table[np.clip(high, 0, len(table) - 1)] >= depth))
            high[go] += width
        return low, high, depth

    def stream(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word of the patterns (on end, with their ``lengths``): the longest match that starts there and
        lies in the pattern, and the least place of its window, NOWHERE if the match is shorter."""
        symbol = self.symbols(words)
        ends = np.cumsum(lengths)
        matched, place = np.zeros(len(words), np.int32), np.full(len(words), self.NOWHERE, np.int64)
        low, high, length = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64), np.zeros(len(lengths), np.int32)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = np.flatnonzero(lengths >= step)
            at = ends[active] - step
            unknown = symbol[at] < 0
            lost = active[unknown]
            low[lost], high[lost], length[lost] = 0, self.size, 0
            active, at = active[~unknown], at[~unknown]
            todo = np.arange(len(active))
            while len(todo):
                k = active[todo]
                lo, hi = self._extended(symbol[at[todo]], low[k], high[k])
                found = hi > lo
                done = k[found]
                low[done], high[done] = lo[found], hi[found]
                length[done] += 1
                todo = todo[~found]
                if len(todo):
                    k = active[todo]
                    low[k], high[k], length[k] = self._parent(low[k], high[k])
            matched[at] = length[active]
            full = np.flatnonzero(length[active] >= self.window)
            place[at[full]] = self.earliest[self.groups.rank(low[active[full]] + 1) - 1]
        return matched, place
