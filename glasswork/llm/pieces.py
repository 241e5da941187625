"""Texts cut at spaces, with a bounded cache from piece to bytes.

Natural text repeats its words, so work done once per distinct piece (hashing,
tokenizing) and joined with ``bytes.join`` is far cheaper than work per word.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import xxhash

CACHE_PIECES = 500_000
# Hashes are quick to make again, so fewer are kept.
HASHED_PIECES = 150_000
LONGEST_CACHED = 64
_WORD = re.compile(r"[^\W_]+")
# Letters whose sums are taken at once, and the numbers of the polynomial.
_STRETCH = 1 << 16
_BASE, _STEP = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)


class PieceCache(dict):
    """``cache[piece]`` makes and remembers; two generations bound its size.

    When the young generation is full it becomes the old one, so pieces in use
    survive and rare ones are forgotten. A forgotten piece is made again, so
    the size never changes a result.
    """

    def __init__(self, make: Callable[[str], bytes], limit: int = CACHE_PIECES):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[piece] = value
        return value

    def join(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


_TOOL: dict = {}


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass



def tool(key: tuple, make: Callable):
    """What a Python worker keeps between tasks under ``key``; only the last one asked for.

    A worker serves many stages. Dropping the tool of the one before, cycles
    included, keeps its memory at one set of caches.
    """
    if key not in _TOOL:
        _TOOL.clear()
        gc.collect()
        _give_back()
        _TOOL[key] = make()
    return _TOOL[key]


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    low = text.lower()
    return [low] if low.isalnum() else _WORD.findall(low)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class WordHasher:
    """64-bit hashes of the words of a text (see ``words_of``), in order."""

    def __init__(self, limit: int = HASHED_PIECES):
        self.cache = PieceCache(self._make, limit)

    @staticmethod
    def _make(piece: str) -> bytes:
        return b"".join([word_hash(w).to_bytes(8, "little") for w in words_of(piece)])

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.cache.join(text.split(" ")), "<u8")


@cache
def _letters(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every code point below ``size``: whether it belongs to words, and a 64-bit value of its own."""
    kinds = np.fromiter(map(str.isalnum, map(chr, range(size))), bool, size)
    return kinds, mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (see ``words_of``) of all texts in order, and how many words each text has.

    A word's hash is a polynomial in its letters, taken from running sums over
    the letters of all texts, so no word becomes an object of its own. Words of
    more than ``LONGEST_CACHED`` letters, where such polynomials can be made to
    collide, are hashed one by one.
    """
    low = [t.lower() for t in texts]
    joined = "\n".join(low)
    if joined.isascii():
        codes, (kinds, values) = np.frombuffer(joined.encode(), np.uint8), _letters(128)
    else:
        codes, (kinds, values) = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), _letters(sys.maxunicode + 1)
    hashes, places, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < len(codes):
        # A stretch ends behind a character between words, or grows until there is one.
        width = _STRETCH
        while a + width < len(codes) and not len(stops := np.flatnonzero(~kinds[codes[a: a + width]])):
            width *= 2
        b = a + int(stops[-1]) + 1 if a + width < len(codes) else len(codes)
        inside = np.zeros(b - a + 2, np.int8)
        inside[1:-1] = kinds[codes[a:b]]
        edges = np.flatnonzero(np.diff(inside))
        first, end = edges[::2], edges[1::2]
        up, down = _powers(1 << max(16, (b - a - 1).bit_length()))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[codes[a:b]] * up[: b - a], out=sums[1:])
        h = mix((sums[end] - sums[first]) * down[first])
        for i in np.flatnonzero(end - first > LONGEST_CACHED):
            h[i] = word_hash(joined[a + first[i]: a + end[i]])
        hashes.append(h)
        places.append(first + a)
        a = b
    bounds = np.cumsum([0, *[len(t) + 1 for t in low]])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(places), bounds))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """A 64-bit hash per run of ``k`` words, in order; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    out = np.zeros(max(1, n - k + 1), np.uint64)
    for i in range(min(k, n)):
        out = mix(out + hashes[i: i + len(out)] + np.uint64(0x9E3779B97F4A7C15))
    return out


def weighted(shingle_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and how often each occurs."""
    return np.unique(shingle_hashes, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller over sum of the larger weights; 0 when either side is empty."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][at], b[1][bt]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if both else 0.0
