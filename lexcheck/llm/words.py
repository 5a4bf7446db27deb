"""Words of many texts as 64-bit hashes, found and hashed by array operations over their bytes."""

from __future__ import annotations

import numpy as np

from lexcheck.llm.common import forget

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SLAB = 1 << 18  # bytes hashed at a time
_ODDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` (at most six) word hashes: these are uniform, so a weighted sum and one
    mixing do."""
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        grams += words[j : j + len(grams)] * _ODDS[j]
    return mixed(grams)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n, 1), _BASE, np.uint64))))


class WordArrays:
    """``raw`` holds the texts with blanks between; words are separated by bytes 0x20 and 0x09-0x0D.

    ``starts`` and ``ends`` are the words' places in ``raw``, ``hashes`` their hashes (a polynomial over the
    bytes, mixed with the length), ``lengths`` the number of words of each text and ``begin`` its first."""

    def __init__(self, texts: list[bytes]) -> None:
        forget()
        self.raw = b" ".join([b"", *texts, b""])
        data = np.frombuffer(self.raw, np.uint8)
        space = _SPACE[data]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = turns[::2], turns[1::2]
        sizes = self.ends - self.starts
        self.hashes = np.zeros(len(sizes), np.uint64)
        powers = _powers(int(sizes.max(initial=0)))
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + _SLAB)))
            first, last = int(self.starts[lo]), int(self.ends[hi - 1])
            place = np.arange(first, last) - np.repeat(self.starts[lo:hi], np.diff(np.append(self.starts[lo:hi], last)))
            letters = np.where(space[first:last], 0, data[first:last]).astype(np.uint64)
            self.hashes[lo:hi] = np.add.reduceat(letters * powers[np.minimum(place, len(powers) - 1)], self.starts[lo:hi] - first)
            lo = hi
        self.hashes = mixed(self.hashes + sizes.astype(np.uint64) * _LENGTH)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.begin = np.searchsorted(self.starts, bounds)
        self.lengths = np.diff(self.begin)
        self.begin = self.begin[:-1]

    def text(self, lo: int, hi: int) -> str:
        """The text from word ``lo`` to before word ``hi``, blanks as they stand."""
        return self.raw[self.starts[lo] : self.ends[hi - 1]].decode()
