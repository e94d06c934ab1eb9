"""Repeated passages by super-k-mer partitioning and exact counting of windows.

Windows of 50 words reach their minimiser's bucket inside super-k-mers; there
their hashes are sorted, equal neighbours compared byte by byte, and occurrences
counted. Strings that come several times are unpacked once and weighted.

Defined cases: words are compared in lower case and punctuation between them
doesn't count; null texts and texts under 50 words have no window; each row
counts its own occurrences, also of a text that repeats, and windows that repeat
within one text count; rows of one doc_id (null too) are reported together; an
empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .superkmers import WORDS, oracle, repeated_spans
from .textkernel import mix, span_hash, string_buffers, symbol_sums, word_bounds, word_hashes


def window_layout(strings: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """(bytes, word starts, word ends, first word of each window, string borders among the windows)."""
    data, offs = string_buffers(pa.array(strings, pa.binary()))
    starts, ends, first = word_bounds(data, offs)
    n = np.diff(first) - words + 1
    border = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(border[-1]) + np.repeat(first[:-1] - border[:-1], n)
    return data, starts, ends, at, border


def count_windows(strings: list[bytes], times: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each window of the strings, which are distinct and come ``times`` often."""
    data, starts, ends, at, border = window_layout(strings, words)
    sums = symbol_sums(word_hashes(data, starts, ends))
    h = mix(span_hash(sums, at, at + words))
    weight = np.repeat(times, np.diff(border))
    order = np.argsort(h, kind="stable")
    hs = h[order]
    cut = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1], [True]]))
    size = np.diff(cut)
    group = np.repeat(np.arange(len(size)), size)
    # each window against the first of its group
    raw = data.tobytes()
    a, b = starts[at], ends[at + words - 1]
    more = np.flatnonzero(np.repeat(size > 1, size))
    x, y = order[more], order[cut[group[more]]]
    same = [raw[p:q] == raw[r:s] for p, q, r, s in zip(a[x].tolist(), b[x].tolist(), a[y].tolist(), b[y].tolist())]
    if not all(same):  # hashes collided: group by the bytes themselves
        keys: dict[bytes, int] = {}
        group = np.array([keys.setdefault(raw[p:q], len(keys)) for p, q in zip(a[order].tolist(), b[order].tolist())])
        size = np.zeros(len(keys))
    total = np.bincount(group, weight[order], len(size)).astype(np.int64)
    out = np.empty(len(h), np.int64)
    out[order] = total[group]
    return out, border


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, copies): spans covered by windows that occur at least twice.

    ``copies`` is the highest number of occurrences among the span's windows.
    """
    return repeated_spans(docs, count_windows, words)


ORACLE = oracle(WORDS, "doc_id, start_word, end_word, copies")
