"""Relevance: BM25 over the candidate corpus, embedding similarity, blend, top-k."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.shingles import pieces
from pagequarry.functions.text import chunks, query_tokens, tokens, words
from pagequarry.schemas import DoubleType, StructField, StructType
from pagequarry.staging import staged

K1, B, FLOOR = 1.5, 0.75, 0.25
MODES = ("keyword", "semantic", "both")
#: texts -> one vector each
Encoder = Callable[[list[str]], np.ndarray]


def document_frequency(toks: DataFrame, column: str = "tokens") -> DataFrame:
    """(token, df)."""
    return toks.select(F.explode(F.array_distinct(column)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def corpus_statistics(pages: DataFrame, terms: list[str], text: str = "text") -> tuple[int, float | None, float | None, dict[str, int]]:
    """(pages, mean length, mean idf of the vocabulary, df of each term), read in one pass over the texts.

    A page adds one row under the empty token, which no text has, to carry its length; so one
    shuffle of the vocabulary has everything. The answer is one row.
    """
    toks = pages.select(tokens(F.col(text)).alias("__t")).select(F.size("__t").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("__t"))).alias("token"))
    counted = toks.groupBy("token").agg(F.count("*").alias("df"), F.sum(F.when(F.col("token") == "", F.col("len"))).alias("total"))
    counted = staged(counted, "vocabulary")
    whole = counted.where("token = ''").first()
    if whole is None:
        return 0, None, None, dict.fromkeys(terms, 0)
    n = F.lit(whole.df)
    found = counted.where("token != ''").agg(F.avg(_idf(n, F.col("df"))).alias("mean_idf"), *[F.max(F.when(F.col("token") == t, F.col("df"))).alias(f"df{i}") for i, t in enumerate(terms)]).first()
    return whole.df, whole.total / whole.df, found.mean_idf, {t: found[f"df{i}"] or 0 for i, t in enumerate(terms)}


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def bm25(pages: DataFrame, query: str, column: str = "bm25", text: str = "text") -> DataFrame:
    """Okapi BM25 of the query's tokens, repeated ones repeatedly; idf below zero becomes a share of the mean idf.

    The corpus is read once for its statistics, which enter the scores' expression as
    constants; term frequencies of the query's few tokens are counted in place.
    """
    terms = Counter(query_tokens(query))
    if not terms:
        return pages.withColumn(column, F.lit(0.0))
    n, avgdl, mean_idf, df = corpus_statistics(pages, list(terms), text)
    length = F.size("__tokens") / avgdl if avgdl else F.lit(None).cast("double")  # null where no page has a token
    total = F.lit(0.0)
    for t, times in terms.items():
        if not df[t]:
            continue
        idf = math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5)
        idf = FLOOR * mean_idf if idf < 0 else idf
        tf = F.size(F.filter("__tokens", _equals(t)))
        total = total + times * F.coalesce(F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length)), F.lit(0.0))
    # the tokens stay a column of their own until the score: merged into it they would be made once for each use
    return pages.withColumn("__tokens", tokens(F.col(text))).select(*pages.columns, total.alias(column))


def minmax(rows: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min) over all rows; a spread under 1e-9 gives zeros."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    x = F.when(F.col("__hi") - F.col("__lo") < 1e-9, 0.0).otherwise((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return rows.crossJoin(F.broadcast(ends)).withColumn(out or column, x).drop("__lo", "__hi")


def keyword_score(pages: DataFrame, query: str, text: str = "text") -> DataFrame:
    """BM25 scaled over all pages to 0 to 1; the ends of the scale are one row, read in a pass of its own."""
    if not query_tokens(query):
        return pages.withColumn("keyword_score", F.lit(0.0))
    scored = bm25(pages, query, "__raw", text)
    ends = scored.agg(F.min("__raw").alias("lo"), F.max("__raw").alias("hi")).first()
    if ends.lo is None or ends.hi - ends.lo < 1e-9:
        return pages.withColumn("keyword_score", F.lit(0.0))
    return scored.select(*pages.columns, F.round((F.col("__raw") - ends.lo) / (ends.hi - ends.lo), 6).alias("keyword_score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def rounded(x: Column, decimals: int) -> Column:
    """To so many decimals, halves of the binary product away from zero."""
    m = 10.0**decimals
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m


def max_pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): component-wise maximum of a key's vectors."""
    each = rows.select(key, F.posexplode(vector).alias("__i", "__x")).groupBy(key, "__i").agg(F.max("__x").alias("__x"))
    pooled = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", "__x"))).alias("__v"))
    return pooled.select(key, F.transform("__v", lambda s: s["__x"]).alias(vector))


def pooled_cosines(chunked: list[list[str] | None], goal: np.ndarray, encoder: Encoder) -> np.ndarray:
    """Cosine of ``goal`` with the component-wise maximum of each text's chunk vectors; all chunks go to the encoder in one call."""
    parts = [x or [""] for x in chunked]
    if not parts:
        return np.zeros(0)
    v = np.asarray(encoder([c for x in parts for c in x]), float)
    v = np.maximum.reduceat(v, np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]), 0)
    size = np.linalg.norm(v, axis=1) * np.linalg.norm(goal)
    return np.divide(v @ goal, size, out=np.zeros(len(v)), where=size > 0)


def text_chunks(text: str | None, size: int = 256) -> list[str]:
    """The same windows as ``chunks`` over a text's words."""
    w = (text or "").split()
    return [" ".join(w[i : i + size]) for i in range(0, max(len(w) - size, 0) + 1, size // 2)]


def semantic_score(pages: DataFrame, query: str, encoder: Encoder | None = None, text: str = "text") -> DataFrame:
    """Cosine of the query with each page's pooled chunks, scaled over all pages; zeros without an encoder.

    The encoder is called for pieces of about 1 MB of text.
    """
    if encoder is None:
        return pages.withColumn("semantic_score", F.lit(0.0))
    goal = np.asarray(encoder([query]), float)[0]
    schema = StructType([*pages.schema.fields, StructField("__cos", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            chunked = [text_chunks(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pooled_cosines(chunked, goal, encoder), pa.float64())], schema.names)

    scored = minmax(pages.mapInArrow(run, schema), "__cos", "semantic_score")
    return scored.withColumn("semantic_score", F.round("semantic_score", 6)).drop("__cos")


def check_rank_arguments(query: str, mode: str, semantic_weight: float) -> None:
    if not query or not query.strip():
        raise ValueError("the query is empty")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    if not 0.0 <= semantic_weight <= 1.0:
        raise ValueError("semantic_weight lies outside 0 to 1")


def blend(rows: DataFrame, mode: str = "both", semantic_weight: float = 0.5) -> DataFrame:
    k, s = F.col("keyword_score"), F.col("semantic_score")
    score = {"keyword": k, "semantic": s, "both": rounded((1.0 - semantic_weight) * k + semantic_weight * s, 6)}[mode]
    return rows.withColumn("relevance_score", score)


def top(rows: DataFrame, k: int | None, order: str, score: str = "relevance_score") -> DataFrame:
    """Best first, ties in input order; none or 0 keeps all, a negative k leaves out the last."""
    best = rows.orderBy(F.desc(score), F.asc(order))
    if not k:
        return best
    return best.limit(k if k > 0 else max(0, rows.count() + k))


def rank(pages: DataFrame, query: str, top_k: int | None = None, mode: str = "both", semantic_weight: float = 0.5, encoder: Encoder | None = None, order: str = "ord", text: str = "text") -> DataFrame:
    """The pages with their scores, by relevance; ``order`` is the column of the input order."""
    check_rank_arguments(query, mode, semantic_weight)
    rows = pages
    if mode != "semantic":
        rows = keyword_score(rows, query, text)
    if mode != "keyword":
        rows = semantic_score(rows, query, encoder, text)
    return top(blend(rows, mode, semantic_weight), top_k, order)


def update_scores(rows: DataFrame, scores: DataFrame, key: str = "ord", score: str = "relevance_score") -> DataFrame:
    """Rows whose key is in ``scores`` take its score."""
    new = scores.select(F.col(key).alias("__key"), F.col(score).alias("__new"))
    return rows.join(new, F.col(key) == F.col("__key"), "left").withColumn(score, F.coalesce("__new", score)).drop("__key", "__new")


def chunk_texts(rows: DataFrame, key: str, text: str = "text", size: int = 256) -> DataFrame:
    """(key, chunk_no, chunk): what an encoder gets of each text."""
    w = rows.select(key, words(F.col(text)).alias("__w"))
    return w.select(key, F.posexplode_outer(chunks(F.col("__w"), size)).alias("chunk_no", "chunk"))
