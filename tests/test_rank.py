import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions.text import query_tokens
from pagequarry.operators import rank as R


def brute_bm25(texts, query):
    docs = [query_tokens(t or "") for t in texts]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for q in query_tokens(query)) for d in docs]


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, text string")


def test_bm25_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["red", "blue", "green", "fox", "dog", "cat"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(60)] + [None]
    got = [r.bm25 for r in R.bm25(pages(spark, texts), "red fox red missing").orderBy("ord").collect()]
    assert np.allclose(got, brute_bm25(texts, "red fox red missing"), atol=1e-12)


def test_blank_corpus_and_stop_word_query_score_zero(spark):
    assert [r.keyword_score for r in R.keyword_score(pages(spark, ["", "the", None]), "fox").collect()] == [0.0] * 3
    assert [r.keyword_score for r in R.keyword_score(pages(spark, ["fox", "dog"]), "the of").collect()] == [0.0] * 2
    assert R.keyword_score(pages(spark, ["x"]).limit(0), "fox").count() == 0


def test_single_page_scores_zero(spark):
    assert R.rank(pages(spark, ["fox fox"]), "fox", mode="keyword").first().relevance_score == 0.0


def test_ties_keep_input_order_and_top_k_forms(spark):
    df = pages(spark, ["dog", "fox", "cat", "fox", "cow"])
    order = lambda k: [r.ord for r in R.rank(df, "fox", k, "keyword").collect()]
    assert order(None) == order(0) == [1, 3, 0, 2, 4]
    assert order(2) == [1, 3] and order(-1) == [1, 3, 0, 2] and order(-9) == []


def test_arguments_are_checked(spark):
    df = pages(spark, ["a"])
    for kw in ({"query": " "}, {"query": "x", "mode": "m"}, {"query": "x", "semantic_weight": 1.5}):
        with pytest.raises(ValueError):
            R.rank(df, **kw)


def test_semantic_scores_by_pooled_chunks(spark):
    def encoder(texts):
        return np.array([[t.count("x") + 0.1, t.count("y") + 0.1] for t in texts])

    df = pages(spark, ["x x x", "y y", "x y", ""])
    got = {r.ord: r.semantic_score for r in R.semantic_score(df, "x", encoder).collect()}
    assert got[0] == 1.0 and got[1] == 0.0 and 0 < got[2] < 1
    both = R.rank(df, "x", mode="both", semantic_weight=0.25, encoder=encoder).collect()
    assert both[0].ord == 0 and both[0].relevance_score == pytest.approx(0.25, abs=1e-6)  # "x" is too short a token
    assert [r.semantic_score for r in R.semantic_score(df, "x", None).collect()] == [0.0] * 4


def test_max_pool_cosine_minmax(spark):
    v = spark.createDataFrame([(1, [1.0, 5.0]), (1, [3.0, 2.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    assert {r.k: r.v for r in R.max_pool(v, "k", "v").collect()} == {1: [3.0, 5.0], 2: [0.0, 1.0]}
    c = v.select(R.cosine(F.col("v"), F.array(F.lit(0.0), F.lit(2.0))).alias("c")).collect()
    assert c[2].c == pytest.approx(1.0)
    flat = R.minmax(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x")
    assert [r.x for r in flat.collect()] == [0.0, 0.0]


def test_encoder_gets_pieces(spark):
    def encoder(texts):
        if sum(map(len, texts)) > 3 << 20:
            raise ValueError("too much at once")
        return np.array([[t.count("x") + 1.0, 1.0] for t in texts])

    df = spark.range(2000).coalesce(1).select(F.col("id").alias("ord"), F.concat_ws(" ", F.repeat(F.lit("x "), F.col("id").cast("int") % 9), F.array_repeat(F.lit("wordsword"), 600)).alias("text"))
    scored = R.semantic_score(df, "x", encoder).select("ord", "semantic_score").collect()
    assert len(scored) == 2000 and max(r.semantic_score for r in scored) == 1.0
