"""Super-k-mers of words: how repeated passages meet without a shuffle of each window.

A window is WORDS consecutive words of one text, lower-cased, joined by single
spaces. Its minimiser is the least hash among its GRAM-word grams. Consecutive
windows with the same minimiser travel as one packed string to the bucket that
the minimiser names, so equal windows always meet. A map task's strings for one
bucket are compressed together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions
from .textkernel import U, chunks, gram_hashes, mix, normalise, sliding_min, string_buffers, word_hashes

WORDS = 50
GRAM = 8
_LOW = U((1 << 20) - 1)
_NO_ID = np.iinfo(np.int64).min
_FLUSH = 48 << 20
_CHUNK = 4 << 20
META = np.dtype([("doc", np.int64), ("mini", U), ("at", np.int32), ("size", np.int32)])


def split(texts: pa.Array, ids: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, list[bytes]]:
    """META rows and packed strings of the texts' super-k-mers."""
    data, starts, ends, first = normalise(*string_buffers(texts))
    n = len(starts)
    if n < words:
        return np.zeros(0, META), []
    gram = min(GRAM, words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    g = gram_hashes(word_hashes(data, starts, ends), gram)
    low = sliding_min((g & ~_LOW) | (np.arange(len(g)).astype(U) & _LOW), words - gram + 1)
    valid = doc[: n - words + 1] == doc[words - 1 :]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]))
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(0, META), []
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    stop = np.flatnonzero(last)
    a, b = starts[begin], ends[stop + words - 1]
    meta = np.empty(len(begin), META)
    d = doc[begin]
    meta["doc"], meta["mini"], meta["at"], meta["size"] = ids[d], low[begin] >> U(20), begin - first[d], b - a
    raw = data.tobytes()
    return meta, [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]


def packed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(part, meta, text): super-k-mers, compressed by bucket, in the bucket's partition."""
    parts = partitions(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas: list[np.ndarray] = []
        strings: list[bytes] = []
        held = 0
        zip_ = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            meta = np.concatenate(metas)
            to = (mix(meta["mini"]) % U(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])
            some = [k for k in range(parts) if cut[k] < cut[k + 1]]
            where = order.tolist()
            out = [pa.array(some, pa.int32())]
            out.append(pa.array([zip_.compress(meta[order[cut[k] : cut[k + 1]]].tobytes()) for k in some], pa.binary()))
            out.append(pa.array([zip_.compress(b"".join([strings[i] for i in where[cut[k] : cut[k + 1]]])) for k in some], pa.binary()))
            metas.clear()
            strings.clear()
            return pa.RecordBatch.from_arrays(out, ["part", "meta", "text"])

        for b in batches:
            for part in chunks(b, "text"):
                ids = part.column("id").fill_null(_NO_ID).to_numpy()
                meta, texts = split(part.column("text"), ids, words)
                if len(meta):
                    metas.append(meta)
                    strings += texts
                    held += int(meta["size"].sum())
                if held >= _FLUSH:
                    yield flush()
                    held = 0
        if metas:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "part int, meta binary, text binary").repartitionById(parts, "part")


@lru_cache(maxsize=1)
def _unzip() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def repeated_spans(docs: DataFrame, find: Callable[[list[bytes], np.ndarray, int], tuple[np.ndarray, np.ndarray]], words: int = WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, copies): merged spans of windows that occur at least twice.

    ``find(strings, times, words)`` gets a bucket's distinct strings, how often each occurs,
    and returns for each string's windows, end to end, their number of occurrences, and the
    strings' borders among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas, raws = [], []
        for b in batches:
            metas += [np.frombuffer(_unzip().decompress(x), META) for x in b.column("meta").to_pylist()]
            raws += [_unzip().decompress(x) for x in b.column("text").to_pylist()]
        if not metas:
            return
        # strings whose minimiser no other string has can't hold a repeated window
        blob = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
        inner = np.concatenate([np.cumsum(m["size"]) - m["size"] for m in metas])
        meta = np.concatenate(metas)
        metas.clear()
        order = np.argsort(meta["mini"], kind="stable")
        mini = meta["mini"][order]
        edge = np.concatenate([[True], mini[1:] != mini[:-1], [True]])
        alone = edge[1:] & edge[:-1]
        order = order[~alone]
        if not len(order):
            return
        meta, blob, inner = meta[order], blob[order], inner[order]
        edge = np.flatnonzero(np.concatenate([[True], meta["mini"][1:] != meta["mini"][:-1], [True]]))
        total = np.concatenate([[0], np.cumsum(meta["size"], dtype=np.int64)])
        at = 0
        while at < len(edge) - 1:
            to = max(at + 1, int(np.searchsorted(total[edge], total[edge[at]] + _CHUNK, "right")) - 1)
            rows = slice(edge[at], edge[to])
            at = to
            mine = meta[rows]
            strings = [raws[k][s : s + n] for k, s, n in zip(blob[rows].tolist(), inner[rows].tolist(), mine["size"].tolist())]
            known: dict[bytes, int] = {}
            uid = np.array([known.setdefault(s, len(known)) for s in strings])
            times = np.bincount(uid)
            n, border = find(list(known), times, words)
            yield _spans(mine, uid, n, border, words)

    kind = "doc_id long, start_word int, end_word int, copies long"
    spans = packed(docs, words).mapInArrow(run, kind)
    return merged(spans)


def _spans(meta: np.ndarray, uid: np.ndarray, n: np.ndarray, border: np.ndarray, words: int) -> pa.RecordBatch:
    """Runs of repeated windows of each string's occurrence."""
    hit = n > 1
    size = np.diff(border)
    owner = np.repeat(np.arange(len(size)), size)
    start = hit.copy()
    start[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
    end = hit.copy()
    end[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    most = np.maximum.reduceat(np.where(hit, n, 0), s) if len(s) else np.zeros(0, np.int64)
    of = owner[s]
    first = np.searchsorted(of, np.arange(len(size) + 1))
    runs = np.diff(first)[uid]
    row = np.repeat(np.arange(len(uid)), runs)
    k = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + first[uid[row]]
    begin = meta["at"][row] + (s[k] - border[of[k]])
    stop = meta["at"][row] + (e[k] - border[of[k]]) + words
    ids = meta["doc"][row]
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _NO_ID), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(most[k].astype(np.int64))], ["doc_id", "start_word", "end_word", "copies"])


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch become one."""
    w = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start_word") <= before, 0).otherwise(1))
    groups = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.max("copies").alias("copies")).drop("island")


def oracle(words: int, columns: str) -> str:
    return rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {words}], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {words - 1})) AS i FROM words WHERE len(w) >= {words})),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows),
hits AS (SELECT doc_id, i, max(n) AS n FROM counted WHERE n > 1 GROUP BY ALL),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {words} THEN 0 ELSE 1 END AS new FROM hits),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked)
SELECT {columns} FROM (
  SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {words} AS INTEGER) AS end_word, CAST(max(n) AS BIGINT) AS copies
  FROM islands GROUP BY doc_id, island)
"""
