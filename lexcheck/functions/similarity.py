"""Jaro-Winkler similarity, and the signature index that prunes its similarity join."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GATE, PREFIX_WEIGHT, PREFIX_MOST = 0.7, 0.1, 4
LAST = chr(0x10FFFF)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """With a bonus for up to four equal leading characters once Jaro exceeds 0.7."""
    base = jaro(a, b)
    if base <= GATE:
        return base
    prefix = 0
    for x, y in zip(a[:PREFIX_MOST], b[:PREFIX_MOST], strict=False):
        if x != y:
            break
        prefix += 1
    return base + PREFIX_WEIGHT * prefix * (1 - base)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(score, T.DoubleType())(a, b)


def threshold(length: int) -> float:
    return 0.834 if length > 4 else 0.77


def letter_counts(words: list[str]) -> np.ndarray:
    """a-z and one bucket for the rest."""
    out = np.zeros((len(words), 27), np.int32)
    for k, w in enumerate(words):
        for c in w:
            out[k, ord(c) - 97 if "a" <= c <= "z" else 26] += 1
    return out


def least_jaro(limit: float, prefix: int) -> float:
    """The least Jaro similarity that leads to ``limit`` with so many equal leading characters; the bonus starts over 0.7."""
    return max(GATE, (limit - PREFIX_WEIGHT * prefix) / (1 - PREFIX_WEIGHT * prefix)) if prefix else limit


class Words:
    """Words of a block, indexed by their signatures, ready to be scored against blocks of terms: the pairs and scores of
    ``jaro_winkler``.

    A word's signature is its multiset of letters as bits: one for each letter and each number of times it occurs at least.
    The bits that two signatures share are the letters in common. Words are sorted, so those that share a
    term's first one to four characters are ranges, and each range has the bound its bonus allows."""

    MOST = 63  # characters in a machine word; pairs with longer ones are scored one by one
    TERMS, PAIRS = 64, 200_000  # bounds of what is held at a time: terms against all words, scored pairs

    def __init__(self, words: list[str]) -> None:
        self.words, self.size, self.scored = words, len(words), 0
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        self.sorted, self.sorted_lengths = [words[i] for i in self.order], self.lengths[self.order]
        counts = letter_counts(self.sorted)
        #: letters by how often: (c, k) says that a word has the letter c at least k times
        self.least = [(c, k) for c in range(counts.shape[1]) for k in range(1, int(counts[:, c].max(initial=0)) + 1)]
        self.signatures = self._signatures(counts)
        self.bounds: dict[int, list[np.ndarray]] = {}
        #: of numbers of letters; bounds over the greatest possible number are cut to one that none reaches
        self.kind = np.dtype(np.uint16 if len(self.least) < 2**16 - 1 else np.int32)
        letters = sorted({c for w in words for c in w})
        self.code = {c: i for i, c in enumerate(letters, 1)}
        self.codes = np.zeros((min(self.MOST, int(self.lengths.max(initial=0))), self.size), np.int32)
        for k, w in enumerate(words):
            if len(w) <= self.MOST:
                self.codes[: len(w), k] = [self.code[c] for c in w]

    def _signatures(self, counts: np.ndarray) -> list[np.ndarray]:
        """64 bits each, as many as there are."""
        out = []
        for lo in range(0, len(self.least), 64):
            made = np.zeros(len(counts), np.uint64)
            for bit, (c, k) in enumerate(self.least[lo : lo + 64]):
                made |= (counts[:, c] >= k).astype(np.uint64) << np.uint64(bit)
            out.append(made)
        return out

    def _bounds(self, length: int) -> list[np.ndarray]:
        """For a term of this length and 0 to 4 equal leading characters, how many letters each word (in sorted order) has to have in common
        with it: with J the least Jaro similarity, (3 J - 1) |a| |b| / (|a| + |b|)."""
        if length not in self.bounds:
            limit = threshold(length)
            need = [np.ceil((3 * least_jaro(limit, p) - 1) * self.sorted_lengths * length / (self.sorted_lengths + length) - 1e-9) for p in range(PREFIX_MOST + 1)]
            self.bounds[length] = [np.minimum(n, len(self.least) + 1).astype(self.kind) for n in need]
        return self.bounds[length]

    def candidates(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(term, word) of the pairs that can reach the term's threshold by their letters in common."""
        mine = self._signatures(letter_counts(terms))
        common = np.zeros((len(terms), self.size), self.kind)
        for theirs, own in zip(self.signatures, mine, strict=True):
            common += np.bitwise_count(own[:, None] & theirs[None, :])
        hits = np.zeros(common.shape, bool)
        for k, term in enumerate(terms):
            bounds = self._bounds(len(term))
            np.greater_equal(common[k], bounds[0], out=hits[k])
            lo, hi = 0, self.size
            for p in range(1, min(PREFIX_MOST, len(term)) + 1):
                lo = bisect.bisect_left(self.sorted, term[:p], lo, hi)
                hi = bisect.bisect_left(self.sorted, term[:p] + LAST, lo, hi)
                if lo == hi:
                    break
                np.greater_equal(common[k, lo:hi], bounds[p][lo:hi], out=hits[k, lo:hi])
        t, w = np.nonzero(hits)
        return t, self.order[w]

    def matches(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, word, score) of all pairs at or over the term's threshold."""
        found = []
        for k in range(0, len(terms), self.TERMS):
            part = terms[k : k + self.TERMS]
            t, w = self.candidates(part)
            self.scored += len(t)
            limit = np.array([threshold(len(x)) for x in part])
            for lo in range(0, len(t), self.PAIRS):
                mine, theirs = t[lo : lo + self.PAIRS], w[lo : lo + self.PAIRS]
                score = self.scores(part, mine, theirs)
                enough = score >= limit[mine]
                found.append((mine[enough] + k, theirs[enough], score[enough]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def scores(self, terms: list[str], t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Jaro-Winkler of the pairs (t, w)."""
        out = np.zeros(len(t))
        sizes = np.array([len(x) for x in terms])
        long = (sizes[t] > self.MOST) | (self.lengths[w] > self.MOST)
        for p in np.flatnonzero(long).tolist():
            out[p] = jaro_winkler(self.words[w[p]], terms[t[p]])
        short = np.flatnonzero(~long)
        if len(short):
            out[short] = self._short_scores(terms, sizes, t[short], w[short])
        return out

    def _short_scores(self, terms: list[str], sizes: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Each letter of the word takes the first free equal one of the term in reach, found as the lowest bit
        of a set of positions; one step per letter serves all pairs."""
        place = np.zeros((len(terms), len(self.code) + 1), np.uint64)
        for k, term in enumerate(terms):
            for j, c in enumerate(term[: self.MOST]):
                if c in self.code:
                    place[k, self.code[c]] |= np.uint64(1 << j)
        n, size = sizes[t], self.lengths[w]
        steps = int(size.max())
        masks = place[t, self.codes[:steps, w]]
        reach = np.maximum(np.maximum(size, n) // 2 - 1, 0)
        one, taken = np.uint64(1), np.zeros(len(t), np.uint64)
        hit = np.zeros(masks.shape, bool)
        for i in range(steps):
            up = (one << np.minimum(reach + i + 1, self.MOST).astype(np.uint64)) - one
            window = up & ~((one << np.clip(i - reach, 0, self.MOST).astype(np.uint64)) - one)
            free = masks[i] & window & ~taken
            low = free & (~free + one)
            taken |= low
            hit[i] = low != 0
        m = hit.sum(0)
        off = np.zeros(len(t), np.int64)
        for i in range(steps):
            low = taken & (~taken + one)
            off += hit[i] & ((masks[i] & low) == 0)
            taken = np.where(hit[i], taken ^ low, taken)
        some = np.maximum(m, 1)
        base = np.where(m > 0, (m / size + m / n + (m - off // 2) / some) / 3, 0.0)
        prefix, equal = np.zeros(len(t), np.int64), np.ones(len(t), bool)
        for i in range(min(PREFIX_MOST, steps)):
            equal &= (masks[i] >> np.uint64(i)) & one == one
            prefix += equal
        return np.where(base <= GATE, base, base + PREFIX_WEIGHT * prefix * (1 - base))
