"""Repeated passages from sorted suffixes that are compared through hashes.

Suffixes begin at each word. Two suffixes' longest common extension is found by
binary search over prefix polynomial hashes, so a comparison takes logarithmic
time whatever they share; a mergesort built on it orders the suffixes, whole
levels at a time. Neighbours whose common extension reaches 50 words are repeats;
the extension is verified on the bytes, as hashes can collide.

A corpus is sorted in buckets: suffixes travel inside super-k-mers, so those that
share their first 50 words always meet, and order beyond a bucket doesn't matter
to the result. Within a bucket, the hash of the leading 8-word gram is the first
key; only suffixes that tie on it are compared further.

Defined cases: words are compared in lower case and punctuation between them
doesn't count; null texts and texts under 50 words have no repeat; each row
counts, also one that repeats another; repeats within one text count; rows of one
doc_id (null too) are reported together; an empty table gives an empty result;
other columns are untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .substring_dedup import window_layout
from .superkmers import GRAM, WORDS, oracle, repeated_spans
from .textkernel import mix, span_hash, symbol_sums, word_hashes


class Suffixes:
    """Suffixes of strings of words, given by first word and end (exclusive) of their string."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> None:
        self.symbols, self.begin, self.stop = np.append(symbols, np.uint64(0)), begin, stop
        self.sums = symbol_sums(symbols)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes a and b share from their start on."""
        pa, pb = self.begin[a], self.begin[b]
        lo = np.zeros(len(a), np.int64)
        hi = np.minimum(self.stop[a] - pa, self.stop[b] - pb)
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) // 2
            same = span_hash(self.sums, pa, pa + mid) == span_hash(self.sums, pb, pb + mid)
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before b; one that ends first comes first, then the lower index."""
        n = self.common(a, b)
        pa, pb = self.begin[a] + n, self.begin[b] + n
        enda, endb = pa >= self.stop[a], pb >= self.stop[b]
        sa, sb = self.symbols[pa], self.symbols[pb]
        return np.where(enda | endb, np.where(enda & endb, a < b, enda), sa < sb)

    def sort(self, key: np.ndarray) -> np.ndarray:
        """Mergesort of all suffixes by (key, suffix)."""
        o = np.argsort(key, kind="stable")
        k = key[o]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
        size = np.diff(cut)
        width = 1
        while True:
            runs = np.flatnonzero(size > width)
            if not len(runs):
                return o
            at = np.arange(size[runs].sum()) - np.repeat(np.cumsum(size[runs]) - size[runs], size[runs])
            base, end = np.repeat(cut[runs], size[runs]), np.repeat(cut[runs + 1], size[runs])
            pos = base + at
            block = at // width
            left = block % 2 == 0
            pair = base + (block // 2) * 2 * width
            other = np.where(left, pair + width, pair)
            lo = np.minimum(other, end)
            hi = np.minimum(other + width, end)
            first = lo.copy()
            me = o[pos]
            while True:  # how many of the sibling block come before this one
                act = np.flatnonzero(lo < hi)
                if not len(act):
                    break
                mid = (lo[act] + hi[act]) // 2
                before = self.less(o[mid], me[act])
                lo[act] = np.where(before, mid + 1, lo[act])
                hi[act] = np.where(before, hi[act], mid)
            target = pair + (at - block * width) + (lo - first)
            o = o.copy()
            o[target] = me
            width *= 2


def repeats(strings: list[bytes], times: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the strings 2 if it occurs more than once, else 1."""
    data, starts, ends, at, border = window_layout(strings, words)
    owner = np.repeat(np.arange(len(strings)), np.diff(border))
    symbols = word_hashes(data, starts, ends)
    last = np.zeros(len(strings), np.int64)
    last[:] = at[border[1:] - 1] + words
    suffixes = Suffixes(symbols, at, last[owner])
    o = suffixes.sort(mix(span_hash(suffixes.sums, at, at + min(GRAM, words))))
    n = np.where(np.repeat(times > 1, np.diff(border)), 2, 1)
    lcp = suffixes.common(o[:-1], o[1:])
    hit = np.flatnonzero(lcp >= words)
    x, y = o[hit], o[hit + 1]
    raw = data.tobytes()
    a, b = starts[at], ends[at + words - 1]
    same = np.array([raw[p:q] == raw[r:s] for p, q, r, s in zip(a[x].tolist(), b[x].tolist(), a[y].tolist(), b[y].tolist())], bool)
    if not same.all():  # a hash collided, so the order may be wrong: count the windows' bytes
        seen: dict[bytes, int] = {}
        for p, q in zip(a.tolist(), b.tolist()):
            seen[raw[p:q]] = seen.get(raw[p:q], 0) + 1
        twice = np.array([seen[raw[p:q]] > 1 for p, q in zip(a.tolist(), b.tolist())])
        return np.where(twice, 2, n), border
    n[x] = n[y] = 2
    return n, border


def duplicate_suffix_spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, start_word, end_word): maximal spans made of repeats of at least ``words`` words."""
    return repeated_spans(docs, repeats, words).drop("copies")


ORACLE = oracle(WORDS, "doc_id, start_word, end_word")
