"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are packed into shards. A shard's lists hold its vectors sorted by each
dimension; sorted access goes down all lists from both ends at once, so an object
is met at the least depth that it has in any list, and this order of meeting is the
same for every query. Shards store their vectors in that order, with the lists'
values at geometric depths. A query scores the objects as they are met (a block of
queries by one matrix product) and stops in a shard once its k-th best score
exceeds the bound of what is unseen: the sum over dimensions of the better of the
query's products with the two values at the present depth. The k best are carried
from shard to shard, so the later bounds are tight.

On vectors of many independent dimensions the bound falls slowly and most objects
are met before it stops a query; results are exact in any case.

Defined cases: rows with a null id, a null or empty vector or one with a null or
NaN component take no part; vectors are compared with those of the same length
only; of rows that share an id the least vector counts; a row is no neighbour of
itself; scores tie at 9 decimals and the lesser id goes first; ids with fewer than
k others get as many; an empty table gives an empty result; other columns are
untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import local_files, new_path

K = 10
EVERY = 100
SHARD = 8192
_QUERIES = 1024
_FIRST = 16


def build_shard(ids: np.ndarray, x: np.ndarray) -> dict[str, object]:
    """The vectors in order of meeting, and at each stop (depth) their number and the lists' values."""
    n, d = x.shape
    order = np.argsort(x, axis=0, kind="stable")
    depth = np.full(n, n, np.int64)
    rank = np.minimum(np.arange(n), np.arange(n)[::-1])
    for k in range(d):
        depth[order[:, k]] = np.minimum(depth[order[:, k]], rank)
    met = np.lexsort((ids, depth))
    stops = [s for s in (_FIRST << r for r in range(40)) if s < (n + 1) // 2]
    low = np.array([x[order[s, np.arange(d)], np.arange(d)] for s in stops]).reshape(len(stops), d)
    high = np.array([x[order[n - 1 - s, np.arange(d)], np.arange(d)] for s in stops]).reshape(len(stops), d)
    upto = np.searchsorted(depth[met], np.array(stops, np.int64), "right")
    return {"dim": d, "ids": ids[met].tobytes(), "vectors": x[met].tobytes(), "upto": upto.astype(np.int64).tobytes(), "low": low.tobytes(), "high": high.tobytes()}


def six_decimals(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 decimals, halves of the binary product away from zero."""
    y = x * 1e6
    whole = np.trunc(y)
    return (whole + np.where(np.abs(y - whole) >= 0.5, np.sign(y), 0.0)) / 1e6


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score, self.id = np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k, c = self.k, scores.shape[1]
        bar = self.score[rows, -1]
        if c > k:
            bar = np.maximum(bar, np.partition(scores, c - k, axis=1)[:, c - k])
        r, j = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        who = np.unique(r)
        r = np.concatenate([np.repeat(who, k), r])
        s = np.concatenate([self.score[rows[who]].ravel(), scores[r[len(who) * k :], j]])
        i = np.concatenate([self.id[rows[who]].ravel(), ids[j]])
        order = np.lexsort((i, -s, r))
        first = np.searchsorted(r[order], who)
        pick = order[(first[:, None] + np.arange(k)).ravel()]
        self.score[rows[who]], self.id[rows[who]] = s[pick].reshape(-1, k), i[pick].reshape(-1, k)


def search(best: Best, q: np.ndarray, own: np.ndarray, shard: dict[str, object]) -> int:
    """Offer a shard's objects to the queries until the threshold stops each; returns the number of scores."""
    d = shard["dim"]
    ids = np.frombuffer(shard["ids"], np.int64)
    x = np.frombuffer(shard["vectors"], np.float64).reshape(-1, d)
    upto = np.frombuffer(shard["upto"], np.int64)
    low, high = (np.frombuffer(shard[k], np.float64).reshape(-1, d) for k in ("low", "high"))
    active = np.arange(len(q))
    at = scored = 0
    for stop in range(len(upto) + 1):
        to = int(upto[stop]) if stop < len(upto) else len(ids)
        for s in range(at, to, 2048):
            e = min(to, s + 2048)
            scores = np.round(q[active] @ x[s:e].T, 9)
            scores[own[active][:, None] == ids[s:e]] = -np.inf
            best.offer(active, scores, ids[s:e])
            scored += scores.size
        at = to
        if at == len(ids):
            break
        qa = q[active]
        bound = np.maximum(qa, 0) @ high[stop] + np.minimum(qa, 0) @ low[stop]
        active = active[best.score[active, -1] <= bound + 1e-8]
        if not len(active):
            break
    return scored


def _clean(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    rows = rows.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def _arrays(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch, for each length of vectors."""
    ids, lists = b.column("id").to_numpy(), b.column("x")
    size = np.diff(lists.offsets.to_numpy())
    values, start = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield ids[at], values[start[at][:, None] + np.arange(d)]


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbour_id, rank, score): for each vector whose id is divisible by ``every`` its k others of highest inner product.

    Queries go in blocks of _QUERIES against all shards. Where there are fewer blocks than
    task slots, the shards are shared out among several tasks a block, whose best are merged.
    """
    spark = vectors.sparkSession
    rows = _clean(vectors)
    path = new_path(spark, "shards")
    kind = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "upto", "low", "high"))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(d: int) -> pa.RecordBatch:
            parts = held.pop(d)
            return pa.RecordBatch.from_pylist([build_shard(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))], kind)

        for b in batches:
            for ids, x in _arrays(b):
                for s in range(0, len(ids), SHARD):
                    held.setdefault(x.shape[1], []).append((ids[s : s + SHARD], x[s : s + SHARD]))
                    if sum(len(p[0]) for p in held[x.shape[1]]) >= SHARD:
                        yield flush(x.shape[1])
        for d in list(held):
            yield flush(d)

    rows.mapInArrow(build, "dim int, ids binary, vectors binary, upto binary, low binary, high binary").write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = local_files(path)
        for b in batches:
            for share in np.unique(b.column("share").to_numpy()):
                part = b.filter(pc.equal(b.column("share"), pa.scalar(int(share), pa.int32())))
                for own, q in ((o[s : s + _QUERIES], x[s : s + _QUERIES]) for o, x in _arrays(part) for s in range(0, len(o), _QUERIES)):
                    best = Best(len(q), k)
                    fragments = sorted(pads.dataset(where, filesystem=fs, format="parquet").get_fragments(pads.field("dim") == q.shape[1]), key=lambda f: f.path)
                    for fragment in fragments[share::shares]:
                        for shards in fragment.to_batches(filter=pads.field("dim") == q.shape[1], batch_size=1):
                            for shard in shards.to_pylist():
                                search(best, q, own, shard)
                    r, c = np.nonzero(best.score > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c])], ["vec_id", "neighbour_id", "score"])

    asked = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // _QUERIES))
    shares = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    queries = queries.repartition(blocks * shares, "block", "share").sortWithinPartitions("block", "share")
    found = queries.select("id", "x", "share").mapInArrow(run, "vec_id long, neighbour_id long, score double")
    w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("vec_id", "neighbour_id", "rank", F.round("score", 6).alias("score"))


ORACLE = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.x, b.x), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS INTEGER) AS rank FROM s)
SELECT vec_id, neighbour_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}
"""
