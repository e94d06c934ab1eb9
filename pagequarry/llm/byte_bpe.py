"""Byte-level BPE encoding and decoding in linear time.

The vocabulary's byte strings, read as Latin-1, form a pyahocorasick automaton
that gives the longest token from each position of a piece. Encoding takes
longest matches and steps back (to a shorter prefix token, or to the token
before) whenever two neighbours can't stand beside each other in a merged
sequence. Compatibility of neighbours follows from the merge ranks and is
memoised; each position is given up at most once, so a piece costs linear time,
and the outcome is exactly that of applying the merges in rank order.

Texts are cut by the tokenizer's own pattern first; cuts at single spaces are
made before it, as they always are borders of the pattern's pieces. Encoded
chunks are kept in a bounded table for as long as a task lasts, which changes
speed only: the worker lives on for other stages and keeps the vocabulary alone.

Defined cases: a null text gives null tokens, an empty text an empty list; text
that holds special tokens' strings is ordinary text; equal texts get equal
tokens; an empty table gives an empty result; a column of the table that has a new
column's name, in whatever case, is replaced by it; ids of which one is null or
outside the vocabulary are decoded to null.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from .shared import added
from .textkernel import chunks, thrifty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TABLE_ENTRIES = 600_000


class _Unsafe(Exception):
    """A chunk whose white space touches the space that it was cut at."""


class _Table(dict):
    """Computes what is missing. Of two generations the older is dropped when the newer is full."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= TABLE_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ids = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.length = [len(b) for b in self.bytes_of]
        self.split = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.trie.add_word(b.decode("latin-1"), i)
        self.trie.make_automaton()
        self.shorter = [self._shorter(b) for b in self.bytes_of]
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in range(self.size):
            left = self.shorter[i]
            while left >= 0:
                right = ranks.get(self.bytes_of[i][self.length[left] :], -1)
                if 0 <= right < i and left < i and self._compatible(left, right):
                    self.halves[i] = (left, right)
                    self.merged[left, right] = i
                    break
                left = self.shorter[left]
        self.fits.clear()
        self.after_space = _Table(self._chunk)
        self.pieces = _Table(lambda s: tuple(self.encode_bytes(s.encode("utf-8", "surrogatepass"))))

    def _shorter(self, b: bytes) -> int:
        """The longest token that is a proper prefix."""
        for n in range(len(b) - 1, 0, -1):
            if (i := self.ids.get(b[:n], -1)) >= 0:
                return i
        return -1

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order leaves ``left`` and ``right`` side by side.

        Undo the later merge of the two at their common border, step by step: if a pair
        met on the way would have merged before the token that now hides it was made,
        the two can't stand together.
        """
        limit = self.size
        while True:
            if self.merged.get((left, right), self.size) < limit:
                return False
            if left > right:
                inner = self.halves[left][1]
                if inner != left:
                    limit, left = left, inner
                    continue
                inner = self.halves[right][0]
                if inner == right:
                    return True
                limit, right = right + 1, inner
            else:
                inner = self.halves[right][0]
                if inner != right:
                    limit, right = right + 1, inner
                    continue
                inner = self.halves[left][1]
                if inner == left:
                    return True
                limit, left = left, inner

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[left, right] = self._compatible(left, right)
        return found

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        length = self.length
        for end, i in self.trie.iter(piece.decode("latin-1")):
            longest[end + 1 - length[i]] = i  # ends only grow
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        fits, compatible, shorter = self.fits, self.compatible, self.shorter
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_at[end]:
                    ok = last < 0 or fits.get((last, token))
                    if ok is None:
                        ok = compatible(last, token)
                    if ok:
                        out.append(token)
                        at = end
                        token = longest[at]
                        break
                token = shorter[token]
                if token < 0:
                    if last < 0:
                        raise ValueError("the vocabulary lacks a byte of this text")
                    open_at[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last
                    break
        return out

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        pieces = self.split(" " + chunk)
        if len(pieces) == 1:
            return tuple(self.encode_bytes(pieces[0].encode("utf-8", "surrogatepass")))
        head, *rest = pieces  # most heads also stand alone, as " word"
        out = [*self.after_space[head[1:]]] if len(head) > 1 else self.encode_bytes(b" ")
        for p in rest:
            out += self.pieces[p]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return list(chain(chain.from_iterable(map(self.pieces.__getitem__, self.split(first))), chain.from_iterable(map(self.after_space.__getitem__, rest))))
            except _Unsafe:
                pass
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def forget(self) -> None:
        """Drops what was kept of the texts; what the vocabulary gives stays."""
        self.after_space.forget()
        self.pieces.forget()
        self.fits.clear()
        gc.collect()  # freed tuples that Python holds on to keep their whole blocks of memory

    def decode_bytes(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))

    def decode(self, tokens: list[int]) -> str:
        return self.decode_bytes(tokens).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY, pattern: str = PATTERN) -> ByteBPE:
    """The encoder of a file of base64 tokens and ranks; built once in a worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return ByteBPE(ranks, pattern)


def _without(rows: DataFrame, *names: str | None) -> DataFrame:
    """The rows without the columns of these names; those that are read stay."""
    new = {n.lower() for n in names if n}
    if "text" in new:
        raise ValueError("the text's own column can't be replaced")
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in new])


def with_tokens(docs: DataFrame, column: str = "tokens", check: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with their token ids; ``check`` names a column that tells whether decoding them gave the text."""
    docs = _without(docs, column, check)
    kinds = [pa.field(column, pa.list_(pa.int32()))] + ([pa.field(check, pa.bool_())] if check else [])

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            for part in chunks(b, "text"):
                texts = part.column("text").to_pylist()
                ids = [None if t is None else bpe.encode(t) for t in texts]
                sizes = np.fromiter((len(x or ()) for x in ids), np.int32, len(ids))
                offs = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(x is None for x in ids), False]))
                flat = pa.array(np.fromiter(chain.from_iterable(x for x in ids if x), np.int32, int(sizes.sum())))
                added = [pa.ListArray.from_arrays(offs, flat)]
                if check:
                    added.append(pa.array([None if t is None else bpe.decode_bytes(x) == t.encode("utf-8", "surrogatepass") for t, x in zip(texts, ids)], pa.bool_()))
                schema = part.schema
                for k in kinds:
                    schema = schema.append(k)
                yield pa.RecordBatch.from_arrays([*part.columns, *added], schema=schema)
        bpe.forget()

    more = {column: ArrayType(IntegerType())} | ({check: BooleanType()} if check else {})
    return docs.mapInArrow(run, added(docs.schema, **more))


def decoded(tokens: DataFrame, column: str = "tokens", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the text that their token ids stand for; null ids give null."""
    tokens = tokens.select(*[F.col(f"`{c}`") for c in tokens.columns if c.lower() != text.lower()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            out = pa.array([None if x is None or any(i is None or not 0 <= i < bpe.size for i in x) else bpe.decode(x) for x in b.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], schema=b.schema.append(pa.field(text, pa.string())))

    return tokens.mapInArrow(run, added(tokens.schema, **{text: StringType()}))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact): exact tells that decoding gave the very text."""
    out = with_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), check="exact", vocabulary=vocabulary)
    return out.select("doc_id", "tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), "exact")
