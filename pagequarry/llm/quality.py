"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of a whole batch come from its byte buffer at once. Trees are grown
in numpy on quantile bins (logistic loss, second-order gains) with at most
``sample_rows`` labelled documents, and stored as complete binary trees in three
flat arrays, so that scoring walks all trees of all documents with one indexing
step a level.

Defined cases: a null text counts as an empty one; texts without words have
zeros as their ratios; equal texts get equal scores; labels of unknown or null
ids are not used; with fewer than two classes among the labels each document
scores 1.0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .shared import added
from .textkernel import chunks, string_buffers, word_bounds, word_hashes

SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 4
BINS = 64
THRESHOLD = 0.5

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "symbol", "exclamation", "wide", "line_feeds", "stops", "distinct", "repeated_next", "bars", "short_words", "long_words")
_CLASSES = np.zeros((9, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASSES[3, list(b"#$%&*<>{}[]\\^~=@_+/")] = True
_CLASSES[4, list(b"!")] = True
_CLASSES[5, 128:] = True
_CLASSES[6, list(b"\n")] = True
_CLASSES[7, list(b".?")] = True
_CLASSES[8, list(b"|")] = True
_BITS = (_CLASSES * (1 << np.arange(9))[:, None]).sum(0).astype(np.uint16)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offs = string_buffers(texts)
    n = len(offs) - 1
    size = np.diff(offs)
    starts, ends, first = word_bounds(data, offs)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    per_word, per_byte = 1 / np.maximum(words, 1), 1 / np.maximum(size, 1)
    bits = _BITS[data]
    counts = []
    for k in range(9):
        at = np.flatnonzero(bits & (1 << k))
        counts.append(np.diff(np.searchsorted(at, offs)))
    upper, digit, punct, symbol, excl, wide, feeds, stops, bars = counts
    h = word_hashes(data, starts, ends)
    length = ends - starts
    key = (h >> np.uint64(20)) | (doc.astype(np.uint64) << np.uint64(44))
    distinct = np.bincount((np.unique(key) >> np.uint64(44)).astype(np.int64), minlength=n)
    again = np.zeros(n)
    if len(h) > 1:
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    short = np.bincount(doc[length <= 2], minlength=n)
    long = np.bincount(doc[length >= 12], minlength=n)
    total = np.bincount(doc, length, minlength=n)
    return np.stack(
        [np.log1p(size), np.log1p(words), total * per_word, upper * per_byte, digit * per_byte, punct * per_byte, symbol * per_byte, excl * per_word, wide * per_byte, feeds * per_word, stops * per_word, distinct * per_word, again * per_word, bars * per_word, short * per_word, long * per_word], 1
    )


@dataclass
class Trees:
    """Complete binary trees in breadth-first order: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        inner = self.feature.shape[1]
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        z = self.base + self.value[tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Trees | None:
    """Fit boosted trees; None where the labels hold one class only."""
    if len(np.unique(y)) < 2:
        return None
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)  # bin b: at most edge b
    flat = binned + np.arange(f) * bins
    inner = 2**depth - 1
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(y.mean() / (1 - y.mean()))))
    z = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            here = node - (2**level - 1)
            at = (flat + here[:, None] * (f * bins)).ravel()
            shape = (2**level, f, bins)
            G = np.bincount(at, np.repeat(g, f), np.prod(shape)).reshape(shape).cumsum(2)
            H = np.bincount(at, np.repeat(h, f), np.prod(shape)).reshape(shape).cumsum(2)
            Gt, Ht = G[:, :, -1:], H[:, :, -1:]
            gain = G**2 / (H + ridge) + (Gt - G) ** 2 / (Ht - H + ridge) - Gt**2 / (Ht + ridge)
            gain[(H < least) | (Ht - H < least)] = 0
            for k, e in enumerate(edges):
                gain[:, k, len(e) :] = 0
            best = gain.reshape(2**level, -1).argmax(1)
            for j, b in enumerate(best):
                k, cut = divmod(int(b), bins)
                if gain[j, k, cut] > 1e-9:
                    i = 2**level - 1 + j
                    out.feature[t, i], out.limit[t, i] = k, edges[k][cut]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.limit[t, node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        out.value[t] = value
        z += value[leaf]
    return out


def with_statistics(docs: DataFrame, column: str) -> DataFrame:
    kind = pa.field(column, pa.list_(pa.float64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, "text"):
                x = statistics(part.column("text"))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, rows], schema=part.schema.append(kind))

    return docs.mapInArrow(run, added(docs.schema, **{column: ArrayType(DoubleType())}))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    there = y.join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")  # labels of other documents don't count against the bound
    chosen = there.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # bounded, so it may be broadcast
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").join(F.broadcast(chosen), "id")
    rows = sorted(with_statistics(picked, "x").drop("text").dropDuplicates(["id"]).collect(), key=lambda r: r.id)
    if not rows:
        return None
    return grow(np.array([r.x for r in rows]), np.array([float(r.y > 0) for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality, keep) for every row: the probability of good quality, and whether it reaches the threshold."""
    trees = fit(docs, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, "text"):
                p = trees.probability(statistics(part.column("text"))) if trees else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], ["doc_id", "quality"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, quality double").withColumn("keep", F.col("quality") >= threshold)
