"""Word shingles as sets of 64-bit hashes, made by numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagequarry.functions.text import SHINGLE_WORDS

#: Texts are worked on in pieces of so many characters.
PIECE = 1 << 20
_P, _Q, _M1, _M2 = 0x9E3779B97F4A7C15, *(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(of: int, n: int) -> np.ndarray:
    each = np.full(n, of, np.uint64)
    each[0] = 1
    return np.cumprod(each)


class Shingler:
    """From lower-case texts to sorted arrays of distinct hashes; a short text is one window, a blank one has none."""

    def __init__(self, n: int = SHINGLE_WORDS) -> None:
        self.n, self.up, self.down = n, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def words(self, text: str) -> np.ndarray:
        """A hash of each word: a polynomial of its bytes, read off one running sum over the text."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        b = np.frombuffer("\n".join(words).encode("utf-8", "surrogatepass"), np.uint8)
        if len(b) > len(self.up):
            self.up, self.down = (_powers(x, 2 * len(b)) for x in (_P, pow(_P, -1, 1 << 64)))
        ends = np.append(np.flatnonzero(b == 10), len(b))
        starts = np.append(0, ends[:-1] + 1)
        total = np.append(np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)]))
        return _mixed((total[ends] - total[starts]) * self.down[starts])

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text or "")
        if not len(w):
            return w
        k = min(self.n, len(w))
        m = len(w) - k + 1
        h = np.full(m, k, np.uint64)
        for i in range(k):
            h = h * _Q + w[i : i + m]
        h = np.sort(_mixed(h))
        return h[np.append(True, h[1:] != h[:-1])]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PIECE`` bytes of ``column``, a string; a larger text is a piece of its own."""
    for b in batches:
        at, lengths = 0, np.array(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + 10_000]), PIECE, "right")))
            yield b.slice(at, n)
            at += n


class Frequent:
    """Misra-Gries counts: what occurs in more than 1 / ``size`` of the additions of a piece stays."""

    def __init__(self, size: int) -> None:
        self.size, self.keys, self.counts = size, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        keys, at = np.unique(np.concatenate([self.keys, hashes]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, np.ones(len(hashes), np.int64)]), len(keys)).astype(np.int64)
        if len(keys) > self.size:
            counts -= np.partition(counts, len(keys) - self.size - 1)[len(keys) - self.size - 1]
            stay = counts > 0
            keys, counts = keys[stay], counts[stay]
        self.keys, self.counts = keys, counts


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return shared / (len(a) + len(b) - shared)
