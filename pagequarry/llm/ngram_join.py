"""N-gram Jaccard join over count vectors in R-trees.

Each document becomes the set of hashes of its word n-grams. Hashing the set's
members into GROUPS groups and counting gives a point; the overlap of two sets is
at most the sum over groups of the smaller count, and for an R-tree's box the sum
over groups of the smaller of the point's count and the box's upper corner. Pairs
whose bound falls short of the overlap that the threshold demands are pruned by
box, then by point; the survivors are verified on their whole sets.

One R-tree over a corpus would be searched in quadratic time, as hashed counts of
unlike documents lie close together. Therefore a forest is built, of documents that
share a rare n-gram: n-grams are put in one order, by the number of documents that
have them. Two sets that reach the threshold have their first common n-gram within
the first (1 - threshold) of either, and enough of both from there on, so documents
are candidates if they meet in such an n-gram's bucket. No pair is left out by this,
whatever the texts; n-grams of one document only (most are) make no bucket.

Documents with one and the same set are collapsed beforehand to the least doc_id.
The buckets of a family of near duplicates differ little, so buckets are put
together by the least id within two steps, and each such unit gets one tree: ids
travel by bucket, a whole set only once to its unit. Units over BLOCK_BYTES are
split, by their buckets or into pairs of blocks, whichever ships less, so that no
task holds more than two blocks. A pair counts in the least unit that both are in
only, so it counts once.

linked_documents returns classes and counts of links, a row for each linked
document, so that its result and what it writes grow with the documents and not
with the pairs; jaccard_pairs returns the pairs of the collapsed documents.

Defined cases: rows without doc_id and texts without words take no part; a text
of fewer than n words is one n-gram; rows that share a doc_id are one document with
the n-grams of them all; pairs are (smaller id, larger id), never an id with itself;
an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .shared import added, ids_for_join, partitions, stash
from .textkernel import U, chunks, gram_hashes, mix, string_buffers, thrifty, word_bounds, word_hashes

N = 3
THRESHOLD = 0.5
GROUPS = 32
NODE = 16
BLOCK_BYTES = 32 << 20
PLACES_BROADCAST = 250_000  # rows of about 100 bytes
PART_GRAMS = 1_000_000  # n-grams to a part of the shuffles that count them
CLASSES = 2000


def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, end to end, and their borders."""
    data, offs = string_buffers(texts)
    starts, ends, first = word_bounds(data, offs)
    w = word_hashes(data, starts, ends)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    grams = gram_hashes(w, n)
    inside = doc[n - 1 :] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], doc[: len(inside)][inside]
    few = np.flatnonzero((words > 0) & (words < n))
    if len(few):
        extra = np.array([np.bitwise_xor.reduce(mix(w[first[i] : first[i + 1]] + np.arange(words[i]).astype(U))) for i in few], U)
        grams, owner = np.concatenate([grams, mix(extra)]), np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(words) + 1))


def counts(grams: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Points: how many of a text's n-grams fall into each group."""
    docs = len(borders) - 1
    owner = np.repeat(np.arange(docs), np.diff(borders))
    group = (mix(grams + U(77)) % U(GROUPS)).astype(np.int64)
    return np.bincount(owner * GROUPS + group, minlength=docs * GROUPS).reshape(docs, GROUPS).astype(np.int32)


class RTree:
    """Packed R-tree over count vectors, leaves of NODE points, searched for all points at once."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((points[:, int(points.var(0).argmax())] if len(points) else sizes, sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > NODE:
            p, s = self.levels[-1]
            at = np.arange(0, len(p), NODE)
            self.levels.append((np.maximum.reduceat(p, at, 0), np.minimum.reduceat(s, at)))

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (i, j) of points that may reach the threshold, each once, a block of points at a time."""
        share = threshold / (1 + threshold)
        n = len(self.levels[0][0])
        top = len(self.levels[-1][0])
        block = max(1, 1_000_000 // max(1, n))
        for at in range(0, n - 1, block):
            q = np.repeat(np.arange(at, min(n, at + block)), top)
            node = np.tile(np.arange(top), min(n, at + block) - at)
            for depth in range(len(self.levels) - 1, -1, -1):
                later = (node + 1) * NODE**depth - 1 > q  # a node of earlier points only has none for q
                q, node = q[later], node[later]
                p, s = self.levels[depth]
                keep = np.zeros(len(q), bool)
                for k in range(0, len(q), 100_000):
                    qq, nn = q[k : k + 100_000], node[k : k + 100_000]
                    bound = np.minimum(self.levels[0][0][qq], p[nn]).sum(1)
                    keep[k : k + 100_000] = bound >= share * (self.levels[0][1][qq] + s[nn]) - 1e-9
                q, node = q[keep], node[keep]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    q = np.repeat(q, NODE)
                    node = (node[:, None] * NODE + np.arange(NODE)).ravel()
                    q, node = q[node < below], node[node < below]
            if len(q):
                yield self.order[q], self.order[node]


class Place:
    """Documents that meet in one tree: their sets, the lesser units each is in, and their blocks where the unit is split."""

    def __init__(self, ids: np.ndarray, lesser: list[frozenset], sets: list[np.ndarray], blocks: np.ndarray | None = None) -> None:
        self.ids, self.lesser, self.blocks = ids, lesser, blocks
        self.elsewhere = np.array([bool(x) for x in lesser])
        self.sizes = np.array([len(x) for x in sets])
        self.border = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate(sets)
        self.rank: np.ndarray | None = None

    def _candidates(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that the tree leaves and that meet in no lesser unit."""
        for i, j in RTree(counts(self.flat, self.border), self.sizes).pairs(threshold):
            if self.blocks is not None:
                across = self.blocks[i] != self.blocks[j]
                i, j = i[across], j[across]
            mine = ~(self.elsewhere[i] & self.elsewhere[j])
            for k in np.flatnonzero(~mine).tolist():
                mine[k] = self.lesser[i[k]].isdisjoint(self.lesser[j[k]])
            if mine.any():
                yield i[mine], j[mine]

    def pairs(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, jaccard) of verified pairs."""
        mark = np.zeros(0, np.int32)
        for i, j in self._candidates(threshold):
            if self.rank is None:
                universe, self.rank = np.unique(self.flat, return_inverse=True)
                mark = np.zeros(len(universe), np.int32)
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            shared = np.empty(len(i), np.int64)
            cut = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
            for s, e in zip(cut[:-1], cut[1:]):
                own = self.rank[self.border[i[s]] : self.border[i[s] + 1]]
                mark[own] = 1
                for k in range(s, e, 2000):
                    js = j[k : min(e, k + 2000)]
                    length = self.sizes[js]
                    start = np.concatenate([[0], np.cumsum(length)[:-1]])
                    pick = np.repeat(self.border[js] - start, length) + np.arange(length.sum())
                    shared[k : k + len(js)] = np.add.reduceat(mark[self.rank[pick]], start)
                mark[own] = 0
            jac = shared / (self.sizes[i] + self.sizes[j] - shared)
            good = jac >= threshold
            if good.any():
                yield i[good], j[good], jac[good]

    def links(self, threshold: float, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document the summed weights of those linked to it, and the least id it is linked to, directly or not."""
        n = len(self.ids)
        total, lab = np.zeros(n, np.int64), np.arange(n)
        for i, j, _ in self.pairs(threshold):
            total += np.bincount(i, weights[j], n).astype(np.int64) + np.bincount(j, weights[i], n).astype(np.int64)
            a, b = lab[i], lab[j]
            new = np.unique(np.stack([a, b], 1)[a != b], axis=0).tolist()
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            for x, y in new:
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if up:
                to = np.arange(n)
                to[list(up)] = [find(x) for x in up]
                lab = to[lab]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, lab, self.ids)
        return total, least[lab]


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their sets end to end and the sets' borders, from a column of texts or one of sets."""
    for b in batches:
        if "grams" in b.schema.names:
            data, offs = string_buffers(b.column("grams"))
            yield b, data.view(U), offs // 8
            continue
        for part in chunks(b, "text"):
            yield part, *gram_sets(part.column("text"), n)


def _bytes_of(grams: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.array([grams[x:y].tobytes() for x, y in zip(borders[:-1], borders[1:])], pa.binary())


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """(id, size, h1, h2) of each document with words: its set's size and hashes."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grams, borders in _sets(batches, n):
            size = np.diff(borders)
            sums = [np.concatenate([[U(0)], np.cumsum(mix(grams + U(s)))]) for s in (11, 23)]
            cols = [rows.column("id"), pa.array(size.astype(np.int32)), *(pa.array((x[borders[1:]] - x[borders[:-1]]).view(np.int64)) for x in sums)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "size", "h1", "h2"]).filter(pa.array(size > 0))

    return docs.mapInArrow(run, "id long, size int, h1 long, h2 long")


def _with_sets(docs: DataFrame, n: int) -> DataFrame:
    """docs with the set of n-grams in the place of the text."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grams, borders in _sets(batches, n):
            cols = [*(rows.column(c) for c in kept), _bytes_of(grams, borders)]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "grams"]).filter(pa.array(np.diff(borders) > 0))

    kept = [c for c in docs.columns if c not in ("text", "grams")]
    return docs.mapInArrow(run, added(docs.select(kept).schema, grams=BinaryType()))


def _merged(docs: DataFrame, n: int) -> DataFrame:
    """(id, grams): the n-grams of all rows that share an id."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in zip(b.column("id").to_pylist(), b.column("sets").to_pylist()):
                grams = np.unique(np.concatenate([np.frombuffer(x, U) for x in sets]))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([grams.tobytes()], pa.binary())], ["id", "grams"])

    return _with_sets(docs, n).groupBy("id").agg(F.collect_list("grams").alias("sets")).mapInArrow(run, "id long, grams binary")


_DEALT = "part int, origin int, blob binary"


def _dealt(to: np.ndarray, origin: int, *columns: np.ndarray) -> pa.RecordBatch:
    """The columns' values by part, one blob a part; bytes of equal place lie together, so that they compress."""
    order = np.argsort(to.astype(np.uint16) if len(to) and to.max() < 1 << 16 else to, kind="stable")
    columns = tuple(x[order] for x in columns)
    size = np.bincount(to)
    cut = np.concatenate([[0], np.cumsum(size)])
    some = np.flatnonzero(size)
    blobs = [b"".join(x[cut[k] : cut[k + 1]].view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns) for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), origin, np.int32)), pa.array(blobs, pa.binary())], ["part", "origin", "blob"])


def _undealt(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns that _dealt put into blobs."""
    width = [np.dtype(k).itemsize for k in kinds]
    found: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = len(blob) // sum(width), 0
        for held, kind, w in zip(found, kinds, width):
            planes = np.frombuffer(blob, np.uint8, n * w, at).reshape(w, n)
            held.append(np.ascontiguousarray(planes.T).view(kind).ravel())
            at += n * w
    return [np.concatenate(x) for x in found]


def _by_part(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """{part: [(origin, blob)]} of one task."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for part, origin, blob in zip(*(b.column(c).to_pylist() for c in ("part", "origin", "blob"))):
            out.setdefault(part, []).append((origin, blob))
    return out


def _pieces(length: int, step: int = 500_000) -> list[slice]:
    return [slice(k, k + step) for k in range(0, length, step)]


def _buckets(docs: list[DataFrame], reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """(ids): sorted documents that may first meet in an n-gram, each list once.

    N-grams go to parts by their hash and are counted there; those that several documents
    have come back to the documents, which choose the first in order and send these out once
    more. Within a part 32 bits stand for an n-gram: where two are taken for one, their
    documents are candidates too many, and none is lost, as all of them count in the order.
    """
    total = reps.agg(F.sum("size")).first()[0] or 0
    parts = max(partitions(reps), -(-total // PART_GRAMS))
    low, share = U(0xFFFFFFFF), threshold / (1 + threshold)

    @thrifty
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            grams, ids = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            held.clear()
            return _dealt(((grams >> U(32)) % U(parts)).astype(np.int64), 0, (grams & low).astype(np.uint32), ids)

        for rows, grams, borders in _sets(batches, n):
            if len(grams):
                held.append((grams, np.repeat(rows.column("id").to_numpy(), np.diff(borders))))
            if sum(len(x) for x, _ in held) >= 500_000:
                yield flush()
        if held:
            yield flush()

    def home(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.view(U)) % U(parts)).astype(np.int64)

    @thrifty
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _by_part(batches).items():
            key, ids = _undealt([x for _, x in blobs], np.uint32, np.int64)
            blobs.clear()
            order = np.argsort(key, kind="stable")
            key, ids = key[order], ids[order]
            times = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
            times = np.repeat(times, times).astype(np.uint32)
            some = times > 1
            key, ids, times = key[some], ids[some], times[some]
            for at in _pieces(len(ids)):
                yield _dealt(home(ids[at]), part, key[at], times[at], ids[at])

    @thrifty
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size = b.column("id").to_numpy(), b.column("size").to_numpy()
            if len(ids):
                yield _dealt(home(ids), -1, ids, size)

    @thrifty
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_part(batches).values():
            docs, sizes = _undealt([x for o, x in blobs if o < 0], np.int64, np.int32)
            given = [(o, *_undealt([x], np.uint32, np.uint32, np.int64)) for o, x in blobs if o >= 0]
            blobs.clear()
            if not given:
                continue
            origin = np.repeat(np.array([x[0] for x in given], np.int32), [len(x[1]) for x in given])
            key, times, ids = (np.concatenate([x[k] for x in given]) for k in (1, 2, 3))
            del given
            order = np.argsort(docs)
            docs, sizes = docs[order], sizes[order].astype(np.int64)
            order = np.lexsort((key, origin, times, ids))
            key, origin, ids = key[order], origin[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            length = np.diff(np.concatenate([first, [len(ids)]]))
            size = sizes[np.searchsorted(docs, ids[first])]
            place = np.arange(len(ids)) - np.repeat(first - (size - length), length)  # those of one document only come first
            size = np.repeat(size, length)
            for k in (1 + np.flatnonzero((ids[1:] == ids[:-1]) & (key[1:] == key[:-1]) & (origin[1:] == origin[:-1]))).tolist():
                place[k] = place[k - 1]
            some = place <= size - np.ceil(threshold * size - 1e-9)
            key, origin, ids, size, place = (x[some] for x in (key, origin, ids, size.astype(np.int32), place.astype(np.int32)))
            for at in _pieces(len(ids)):
                yield _dealt(origin[at].astype(np.int64), 0, key[at], ids[at], size[at], place[at])

    def may_link(size_a: np.ndarray, place_a: np.ndarray, size_b: np.ndarray, place_b: np.ndarray) -> np.ndarray:
        return np.minimum(size_a - place_a, size_b - place_b) >= share * (size_a + size_b) - 1e-9

    @thrifty
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _by_part(batches).values():
            key, ids, size, place = _undealt([x for _, x in blobs], np.uint32, np.int64, np.int32, np.int32)
            blobs.clear()
            order = np.lexsort((ids, key))
            key, ids, size, place = key[order], ids[order], size[order].astype(np.int64), place[order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            length = np.diff(cut)
            a = cut[:-1][length == 2]
            a = a[(ids[a] != ids[a + 1]) & may_link(size[a], place[a], size[a + 1], place[a + 1])]
            lists = {x.tobytes() for x in np.stack([ids[a], ids[a + 1]], 1)}
            for s, e in zip(cut[:-1][length > 2].tolist(), cut[1:][length > 2].tolist()):
                kinds, which, times = np.unique(size[s:e] << 32 | place[s:e], return_inverse=True, return_counts=True)
                here = ids[s:e]
                if len(kinds) <= CLASSES:  # those without a partner go
                    x, y = kinds >> 32, kinds & 0xFFFFFFFF
                    may = may_link(x[:, None], y[:, None], x, y)
                    may[np.arange(len(x)), np.arange(len(x))] &= times > 1
                    here = here[may.any(1)[which]]
                here = np.unique(here)
                if len(here) > 1:
                    lists.add(here.tobytes())
            some = sorted(lists)
            for at in _pieces(len(some), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(some[at], pa.binary())], ["ids"])

    sent = docs[0].mapInArrow(send, _DEALT)
    for more in docs[1:]:
        sent = sent.unionByName(more.mapInArrow(send, _DEALT))
    counted = sent.repartitionById(parts, "part").mapInArrow(count, _DEALT)
    known = counted.unionByName(reps.select("id", "size").mapInArrow(measure, _DEALT))
    chosen = known.repartitionById(parts, "part").mapInArrow(choose, _DEALT)
    return chosen.repartitionById(parts, "part").mapInArrow(meet, "ids binary").distinct()


def _members(buckets: DataFrame) -> DataFrame:
    """(bucket, least, id): a bucket's documents and the least of them."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.int64) for x in b.column("ids").to_pylist()]
            if not ids:
                continue
            size = np.array([len(x) for x in ids])
            cols = [np.repeat(b.column("bucket").to_numpy(), size), np.repeat([x[0] for x in ids], size), np.concatenate(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "least", "id"])

    return buckets.select(F.xxhash64("ids").alias("bucket"), "ids").mapInArrow(run, "bucket long, least long, id long")


def _placed(buckets: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, size, units, places): the units and places of each document; a place is (place, unit, block, split, weight).

    Only ids and sizes are shuffled here. Where a unit is split, ``split`` is set and only pairs
    of unlike blocks count, but for the places of one block with itself.
    """
    m = _members(buckets)
    near = m.groupBy("id").agg(F.min("least").alias("near")).join(reps.select("id", "size", "weight"), "id")
    m = stash(m.drop("least").join(near, "id"), "members")
    of_bucket = m.groupBy("bucket").agg(F.min("near").alias("family"), (F.sum("size") * 8).alias("bucket_bytes"))
    m = stash(m.drop("near").join(of_bucket, "bucket"), "families")
    family = m.groupBy("family", "id").agg(F.first("size").alias("size")).groupBy("family").agg((F.sum("size") * 8).alias("family_bytes"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_BYTES)
    large = stash(family.where(F.col("family_bytes") > BLOCK_BYTES), "large-families")
    by_bucket = m.join(F.broadcast(large) if large.count() <= PLACES_BROADCAST else large, "family").groupBy("family", "family_bytes", "bucket").agg(F.first("bucket_bytes").alias("bucket_bytes"))
    by_bucket = by_bucket.groupBy("family", "family_bytes").agg(F.sum(blocks("bucket_bytes") * F.col("bucket_bytes")).alias("ship")).select("family", "family_bytes", (F.col("ship") < blocks("family_bytes") * F.col("family_bytes")).alias("apart"))
    m = m.join(ids_for_join(stash(by_bucket, "large-families")), "family", "left")
    apart = F.coalesce("apart", F.lit(False))
    unit = F.when(apart, F.xxhash64(F.lit("bucket"), "bucket")).otherwise(F.xxhash64(F.lit("family"), "family"))
    n = F.coalesce(F.when(apart, blocks("bucket_bytes")).otherwise(blocks("family_bytes")), F.lit(1)).cast("int")
    m = m.select("id", "size", "weight", unit.alias("unit"), n.alias("n"))
    m = m.groupBy("unit", "id").agg(F.first("size").alias("size"), F.first("weight").alias("weight"), F.first("n").alias("n"))
    m = m.withColumn("block", F.pmod(F.xxhash64("id", "unit"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.when(F.col("n") == 1, F.col("unit")).otherwise(F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other")))
    place = F.struct(at.alias("place"), "unit", "block", (F.col("block") != F.col("other")).alias("split"), "weight")
    # the block with itself and with another are different places, so `split` is one value in each
    return m.groupBy("id").agg(F.first("size").alias("size"), F.collect_set("unit").alias("units"), F.collect_list(place).alias("places"))


def _search(rows: DataFrame, threshold: float, summary: bool) -> DataFrame:
    """Verified pairs of each place; or for ``summary`` (id, links, root) of its linked documents. Rows come sorted by place."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple[np.ndarray, ...]] = []
        names = ["id", "links", "root"] if summary else ["doc_a", "doc_b", "jaccard"]

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                lesser = [frozenset(u for u in x[6] if u < x[4]) for x in held]
                here = Place(np.array([x[1] for x in held]), lesser, [np.frombuffer(x[7], U) for x in held], np.array([x[2] for x in held]) if held[0][3] else None)
                if summary:
                    links, root = here.links(threshold, np.array([x[5] for x in held], np.int64))
                    some = links > 0
                    done.append((here.ids[some], links[some], root[some]))
                else:
                    for i, j, jac in here.pairs(threshold):
                        a, b = here.ids[i], here.ids[j]
                        done.append((np.minimum(a, b), np.maximum(a, b), jac))
                        if sum(len(x[0]) for x in done) > 200_000:
                            yield out()
            held.clear()

        def out() -> pa.RecordBatch:
            cols = [np.concatenate([x[k] for x in done]) for k in range(3)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("place", "id", "block", "split", "unit", "weight", "units", "grams"))):
                if held and held[0][0] != row[0]:
                    yield from close()
                    if len(done) > 1000:
                        yield out()
                held.append(row)
        yield from close()
        if done:
            yield out()

    return rows.mapInArrow(run, "id long, links long, root long" if summary else "doc_a long, doc_b long, jaccard double")


def _joined(docs: DataFrame, n: int, threshold: float, summary: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rep, copies) of each set that several documents have; (rep, id) of those others; what the search finds among the rest."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text")).where("id is not null and text is not null")
    feats = stash(_signed(texts, n), "signatures")
    again = stash(feats.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    sources = [texts]
    if not again.isEmpty():  # rows that share an id are one document
        hot = ids_for_join(again)
        sources = [texts.join(hot, "id", "left_anti"), stash(_merged(texts.join(hot, "id", "left_semi"), n), "merged-sets")]
        feats = stash(feats.join(hot, "id", "left_anti").unionByName(_signed(sources[1], n)), "signatures")
    own = ["size", "h1", "h2"]
    alike = stash(feats.groupBy(*own).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "same-sets")
    marked = feats.join(ids_for_join(alike), own, "left")
    same = stash(marked.where("id != rep").select("rep", "id"), "same-set-members")
    reps = stash(marked.where("rep is null or id = rep").select("id", "size", F.coalesce("copies", F.lit(1)).alias("weight")), "representatives")
    copies = ids_for_join(same.select("id"))
    buckets = stash(_buckets([x.join(copies, "id", "left_anti") for x in sources], reps, n, threshold), "buckets")
    places = stash(_placed(buckets, reps), "places")
    shipped = (places.agg(F.sum((F.col("size") + F.size("units")) * 8 * F.size("places"))).first() or [0])[0] or 0
    found = [_with_sets(x.join(ids_for_join(places.drop("size"), PLACES_BROADCAST), "id"), n) for x in sources]
    found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    parts = partitions(docs, int(shipped))
    rows = found.select("id", "units", "grams", F.inline("places")).repartition(parts, "place").sortWithinPartitions("place")
    return alike.select("rep", "copies"), same, _search(rows, threshold, summary)


def jaccard_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard) of documents whose n-gram sets reach the threshold, equal sets collapsed."""
    _, same, found = _joined(docs, n, threshold, False)
    return same.select(F.col("rep").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard")).unionByName(found)


def linked_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): each document that reaches the threshold with another.

    ``links`` is the number of documents it reaches it with, copies included; ``class_id`` is
    the least doc_id of the documents linked to it, directly or by others.
    """
    sets, same, found = _joined(docs, n, threshold, True)
    found = stash(found, "links")
    total = found.select("id", "links").unionByName(sets.select(F.col("rep").alias("id"), (F.col("copies") - 1).alias("links"))).groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("id").alias("doc_a"), F.col("root").alias("doc_b")))
    total = stash(total.join(classes, "id", "left").select("id", F.coalesce("root", "id").alias("class_id"), "links"), "linked")
    copies = same.join(ids_for_join(total.select(F.col("id").alias("rep"), "class_id", "links")), "rep").select("id", "class_id", "links")
    return total.unionByName(copies).withColumnRenamed("id", "doc_id")


def _superfluous(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id) of each document that isn't the least of its class."""
    _, same, found = _joined(docs, n, threshold, True)
    classes = components(stash(found.select(F.col("id").alias("doc_a"), F.col("root").alias("doc_b")), "links"))
    return classes.select("id").unionByName(same.select("id"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of each id in pairs (doc_a, doc_b) but the roots, root being its group's least id; alternating stars.

    Minima are partial sums joined back, so that the star of a hot id is never held by one task.
    """
    edges = stash(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "edges")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        edges = stash(small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the least doc_id of each group of linked pairs; all columns as they are.

    Where rows share a doc_id but not the text, each of their texts is searched and goes or stays by itself.
    """
    row_id, digest = F.col("doc_id").cast("long"), F.md5("text")
    rows = docs.select(row_id.alias("id"), digest.alias("digest"), "text").where("id is not null and text is not null")
    unlike = stash(rows.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("id"), "unlike-rows")
    if unlike.isEmpty():
        gone = stash(_superfluous(docs, n, threshold).select(F.col("id").alias("__pq_gone")), "near-gone")
        return docs.join(ids_for_join(gone), row_id == F.col("__pq_gone"), "left_anti")
    # numbered in the order of doc_id, so that the least of a group has the least doc_id
    keys = stash(rows.select("id", "digest").distinct().orderBy("id", "digest").withColumn("doc_id", F.monotonically_increasing_id()), "row-keys")
    gone = keys.join(_superfluous(rows.join(keys, ["id", "digest"]).select("doc_id", "text"), n, threshold).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    gone = stash(gone.select(F.col("id").alias("__pq_gone"), F.col("digest").alias("__pq_digest")), "near-gone")
    return docs.join(ids_for_join(gone), (row_id == F.col("__pq_gone")) & (digest == F.col("__pq_digest")), "left_anti")


ORACLE = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {N - 1}], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sized AS (SELECT doc_id, g, count(*) OVER (PARTITION BY doc_id) AS n FROM grams),
near AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM near WHERE jaccard >= {THRESHOLD}),
reached(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a),
class AS (SELECT a, min(b) AS class_id FROM reached GROUP BY a)
SELECT a AS doc_id, class_id, count(*) AS links FROM linked JOIN class USING (a) GROUP BY ALL
"""
