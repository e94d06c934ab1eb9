"""Vectorised numpy kernels over the raw UTF-8 buffers of Arrow string columns.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes. Hashes are
64-bit polynomials with wrap-around arithmetic, read from prefix sums, so any
span of words is hashed with two lookups and one multiplication.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
IBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 20

_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@lru_cache(maxsize=8)
def byte_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


class _Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            a, b = np.full(size, BASE), np.full(size, IBASE)
            a[0] = b[0] = U(1)
            self.up, self.down = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self.up, self.down


POWERS = _Powers()


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel after which the worker, which lives on for other stages, gives its free memory back."""

    @wraps(run)
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        POWERS.up = POWERS.down = np.ones(1, U)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return kernel


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary array; nulls read as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text and at most 4096 rows, one row at least."""
    _, offs = string_buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(at + 4096, max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word (n+1 values)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = _is_word[data]
    edge = np.empty(len(w) + 1, bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    # a text's border splits a word that would run across it
    inner = offs[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    both = inner[w[inner] & w[inner - 1]]
    cut = np.flatnonzero(edge)
    if len(both):
        cut = np.sort(np.concatenate([cut, both, both]))
    starts, ends = cut[::2], cut[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """S with S[i] = sum of T[b_j] * BASE**j for j < i, modulo 2**64."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(byte_table(seed)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.get(len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return mix(span_hash(prefix_sums(data, seed), starts, ends) + (ends - starts).astype(U))


def symbol_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums over 64-bit symbols, for hashing spans of them with span_hash."""
    up, _ = POWERS.get(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n-1 positions have none."""
    if len(words) < n:
        return np.zeros(0, U)
    at = np.arange(len(words) - n + 1)
    return mix(span_hash(symbol_sums(words), at, at + n))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = w - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words joined by single spaces, one space after each word.

    Returns the bytes, each word's start and end in them, and each text's first word.
    """
    starts, ends, first = word_bounds(data, offs)
    if len(starts) == 0:
        return np.zeros(0, np.uint8), starts, ends, first
    size = ends - starts
    new_end = np.cumsum(size + 1)
    new_start = new_end - size - 1
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.subtract.at(keep, ends, 1)
    out = np.full(int(new_end[-1]), 32, np.uint8)
    target = np.ones(len(out), bool)
    target[new_end - 1] = False
    out[target] = data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
    return out, new_start, new_end - 1, first
