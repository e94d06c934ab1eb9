"""Toxicity by subword-bag embeddings and a linear softmax.

A document is the mean of the embeddings of its character 3- to 5-grams, taken
inside words with the word's borders as characters; a linear layer and softmax
give the two classes. Embeddings and layer are trained jointly in numpy (Adam)
on at most ``sample_rows`` labelled documents, whole texts and all their n-grams.
In the mean an n-gram weighs as its rarity, log((n + 1) / documents with it), so
that a few telling words aren't averaged away in a long text. A misspelling shares
most n-grams with the right spelling and so most of its vector.

The result hardly hangs on the seed: a fit whose loss stays high is tried again for
longer, up to three times, and the model is the mean of several fits (the logit is
linear in the n-grams).

For scoring, embedding and layer collapse into one number per n-gram bucket; a
document's logit is the mean of these numbers plus a bias, computed for whole
Arrow batches at once. Means are shrunk by PRIOR neutral n-grams, so that a few
odd words don't condemn a short text, and a word counts once in a run of itself.

Defined cases: a null text or one without words scores 0.0 and is not toxic;
duplicated rows are scored alike; labels of unknown or null ids are not used;
with fewer than two classes among the labels every document scores 0.0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .shared import added, local_files, new_path
from .textkernel import chunks

BUCKETS = 1 << 17
DIM = 4
SIZES = (3, 4, 5)
PRIOR = 60
SAMPLE_ROWS = 6000
THRESHOLD = 0.5
BATCH = 256
EPOCHS = 6
FITS = 3
LEAST_STEPS = 150
PLATEAU = 0.05
LEARNING_RATE = 0.15
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_SPACE = np.uint32(32)
_BAGS = pa.schema([("id", pa.int64()), ("u", pa.binary()), ("v", pa.binary()), ("y", pa.int32()), ("n", pa.int64())])


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as lower-case code points, each framed by line feeds; and their borders."""
    low = [(t or "").lower() for t in texts]
    flat = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low)) + 1
    return flat, np.concatenate([[0], np.cumsum(size)])


def _repeats(cp: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether each position lies in a word that equals the word before it."""
    change = np.flatnonzero(np.diff(word.view(np.int8)))  # frames make the first and last position no word
    starts, ends = change[::2] + 1, change[1::2] + 1
    out = np.zeros(len(cp) + 1, bool)
    if len(starts) < 2:
        return out
    size = ends - starts
    sums = np.concatenate([[0], np.cumsum(cp * (cp ^ np.uint32(0x5BD1)), dtype=np.int64)])
    total = sums[ends] - sums[starts]
    same = np.concatenate([[False], (total[1:] == total[:-1]) & (size[1:] == size[:-1]) & (cp[starts[1:]] == cp[starts[:-1]])])
    step = np.zeros(len(cp) + 1, np.int8)
    step[starts[same]] = 1
    step[ends[same]] = -1
    return np.cumsum(step, dtype=np.int8).view(bool)


def ngram_ids(cp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, bucket) of each n-gram inside a word with its borders, for each size.

    Every separator counts as the same border character.
    """
    n = len(cp)
    word = (cp >= 128) | ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57))
    cp = np.where(word, cp, _SPACE)
    again = _repeats(cp, word)
    stop = ~word
    stop_at = np.flatnonzero(stop)
    gap = np.diff(np.concatenate([[-1], stop_at, [n]]))
    # distance to the next border after each position
    nxt = np.repeat(np.concatenate([stop_at, [n + 9]]), gap)[:n]
    ahead = np.empty(n, np.int64)
    ahead[:-1] = nxt[1:] - np.arange(n - 1)
    ahead[-1] = 9
    h = cp * _M[0]
    made = 1
    for size in SIZES:
        while made < size:
            h = h[:-1] ^ (h[:-1] >> np.uint32(15))
            h = (h + cp[made:]) * _M[made % 5]
            made += 1
        pos = np.flatnonzero((ahead[: len(h)] >= size - 1) & (word[: len(h)] | word[1 : len(h) + 1]) & ~again[1 : len(h) + 1])
        g = h[pos]
        yield pos, ((g ^ (g >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's n-grams."""
    cp, _ = code_points([text])
    ids = np.concatenate([b for _, b in ngram_ids(cp)])
    u, c = np.unique(ids, return_counts=True)
    return u.astype(np.int32), (c / (len(ids) + PRIOR)).astype(np.float32)


def one_fit(indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, labels: np.ndarray, width: int, epochs: int, seed: int, lr: float) -> tuple[np.ndarray, float, float]:
    """(logit of each used n-gram, bias, mean loss of the last epoch) of one joint fit; its steps shrink linearly to none."""
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (width, DIM)).astype(np.float32)
    W = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    cost = np.array([1.0, (labels == 0).sum() / max(1, (labels == 1).sum())], np.float32) ** 0.5
    # one second moment for each tensor: an n-gram's step stays in proportion to its gradient
    state = [[np.zeros_like(p), 0.0] for p in (E, W, b)]
    n = len(labels)
    step, steps, loss = 0, epochs * -(-n // BATCH), 0.0
    for _ in range(epochs):
        order = rng.permutation(n)
        loss = 0.0
        for at in range(0, n, BATCH):
            step += 1
            rows = order[at : at + BATCH]
            size = indptr[rows + 1] - indptr[rows]
            rows, size = rows[size > 0], size[size > 0]
            if not len(rows):
                continue
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            pick = np.repeat(indptr[rows] - start, size) + np.arange(size.sum())
            c, v = cols[pick], vals[pick]
            mean = np.add.reduceat(E[c] * v[:, None], start)
            z = mean @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[rows]
            loss -= float((np.log(p[np.arange(len(rows)), y] + 1e-9) * cost[y]).sum())
            p[np.arange(len(rows)), y] -= 1
            g = p * cost[y][:, None] / len(rows)
            back = g @ W.T
            gE = np.stack([np.bincount(c, np.repeat(back[:, k], size) * v, width) for k in range(DIM)], 1).astype(np.float32)
            rate = lr * (1 - (step - 1) / steps) / (1 - 0.9**step)
            for x, gx, st in zip((E, W, b), (gE, mean.T @ g, g.sum(0)), state):
                m = st[0]
                m *= 0.9
                m += 0.1 * gx
                st[1] = 0.99 * st[1] + 0.01 * float((gx * gx).mean())
                x -= rate / (np.sqrt(st[1] / (1 - 0.99**step)) + 1e-12) * m
        loss /= n
    return E @ (W[:, 1] - W[:, 0]), float(b[1] - b[0]), loss


def train_csr(indptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, lr: float = LEARNING_RATE) -> tuple[np.ndarray, float]:
    """Each bucket's logit and the bias, the mean of FITS fits from different beginnings. Overwrites ``cols`` and ``vals``.

    A fit whose loss hasn't come down to PLATEAU begins anew with twice the epochs, three times at most; the best one counts.
    """
    labels = np.asarray(labels, np.int64)
    nothing = np.zeros(BUCKETS, np.float32), -np.inf
    if len(np.unique(labels)) < 2:
        return nothing
    df = np.bincount(cols, minlength=BUCKETS)
    used = np.flatnonzero(df)
    if not len(used):
        return nothing
    rarity = np.log((len(labels) + 1) / df[used]).astype(np.float32)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    cols[:] = place[cols]
    vals *= rarity[cols]
    table, bias = np.zeros(BUCKETS, np.float32), 0.0
    least = -(-LEAST_STEPS // -(-len(labels) // BATCH))
    for k in range(FITS):
        best = None
        for again in range(3):
            got = one_fit(indptr, cols, vals, labels, len(used), max(epochs, least) << again, seed + 1000 * again + k, lr)
            best = got if best is None or got[2] < best[2] else best
            if best[2] <= PLATEAU:
                break
        table[used] += best[0] * rarity / FITS
        bias += best[1] / FITS
    return table, bias


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, lr: float = LEARNING_RATE) -> tuple[np.ndarray, float]:
    """``train_csr`` of a list of bags."""
    size = np.array([len(u) for u, _ in bags], np.int64)
    cols, vals = (np.concatenate([x[k] for x in bags]) if bags else np.zeros(0, t) for k, t in ((0, np.int32), (1, np.float32)))
    return train_csr(np.concatenate([[0], np.cumsum(size)]), cols.astype(np.int32), vals.astype(np.float32), labels, epochs, seed, lr)


def score(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of the toxic class for each text."""
    cp, borders = code_points(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for pos, ids in ngram_ids(cp):
        cut = np.searchsorted(pos, borders)
        sums = np.concatenate([[0.0], np.cumsum(table[ids], dtype=np.float64)])
        total += sums[cut[1:]] - sums[cut[:-1]]
        count += np.diff(cut)
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-(total / (count + PRIOR) + bias)))
    return np.where(count > 0, p, 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents, chosen by a hash of the id."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(target).cast("int").alias("y"))
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    there = y.join(picked.select("id"), "id", "left_semi")  # labels of other documents don't count against the bound
    chosen = there.orderBy(F.xxhash64("id"), "id").limit(rows)  # bounded, so it may be broadcast
    return picked.join(F.broadcast(chosen), "id")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """The model of the labelled sample; n-grams are counted on the executors.

    The bags reach the driver as a table of the shared folder, a few rows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, "text"):
                bags = [bag(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), *(pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1))], ["id", "y", "u", "v"])

    found = labelled_sample(docs, labels, "toxic", sample_rows).mapInArrow(run, "id long, y int, u binary, v binary")
    one = found.groupBy("id").agg(F.min(F.struct("u", "v", "y")).alias("b")).select("id", "b.*")  # of rows that share an id the least bag
    path = new_path(docs.sparkSession, "labelled-bags")
    one.withColumn("n", (F.length("u") / 4).cast("long")).write.parquet(path)
    fs, where = local_files(path)
    table = pads.dataset(where, filesystem=fs, schema=_BAGS, format="parquet")
    head = table.to_table(columns=["id", "y", "n"])
    ids, y, n = (head.column(c).to_numpy() for c in ("id", "y", "n"))
    order = np.argsort(ids, kind="stable")  # rows come in any order, the fit doesn't
    ids, y = ids[order], y[order]
    indptr = np.concatenate([[0], np.cumsum(n[order])]).astype(np.int64)
    cols, vals = np.empty(indptr[-1], np.int32), np.empty(indptr[-1], np.float32)
    for b in table.to_batches(columns=["id", "u", "v"], batch_size=64, batch_readahead=1, fragment_readahead=1):
        for at, u, v in zip(np.searchsorted(ids, b.column("id").to_numpy()).tolist(), b.column("u"), b.column("v")):
            cols[indptr[at] : indptr[at + 1]] = np.frombuffer(u.as_buffer(), np.int32)
            vals[indptr[at] : indptr[at + 1]] = np.frombuffer(v.as_buffer(), np.float32)
    return train_csr(indptr, cols, vals, y)


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], column: str) -> DataFrame:
    """The documents with one more column: the probability of being toxic."""
    table, bias = model
    out = pa.field(column, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(b, "text"):
                p = score(part.column("text").to_pylist(), table, bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], schema=part.schema.append(out))

    return docs.mapInArrow(run, added(docs.schema, **{column: DoubleType()}))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxicity) of each document whose probability reaches the threshold."""
    model = fit(docs, labels, sample_rows)
    scored = with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "toxicity")
    return scored.where(F.col("toxicity") >= threshold).select("doc_id", "toxicity")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents below the threshold, all columns as they are."""
    model = fit(docs, labels, sample_rows)
    return with_toxicity(docs, model, "__pq_toxicity").where(F.col("__pq_toxicity") < threshold).drop("__pq_toxicity")
