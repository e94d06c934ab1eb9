import random
import re

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import text as X
from pagequarry.functions import urls as U


def _one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("The Quick-brown FOX", ["quick", "brown", "fox"]), ("café naïve x", ["caf", "na", "ve"]), ("a b c 42", ["42"]), ("", []), (None, []), ("go go", ["go", "go"])],
)
def test_tokens(spark, text, want):
    assert _one(spark, text, X.tokens) == want
    assert X.query_tokens(text or "") == want


def test_stop_words_are_thirty():
    assert len(set(X.STOP_WORDS)) == 30


@pytest.mark.parametrize("text", ["  a b\n\tc\x1cd ", "x\xa0y", "", "\n"])
def test_clean_text(spark, text):
    assert _one(spark, text, X.clean_text) == re.sub(r"\s+", " ", text).strip()


@pytest.mark.parametrize("html,want", [("<p>a</p><b>c</b>", "a c"), ("<script>x<1</script>", "x"), ("no tags", "no tags"), ("<a\nhref='x'>t</a>", "t"), ("", "")])
def test_strip_html(spark, html, want):
    assert _one(spark, html, X.strip_html) == want


def test_strip_html_cuts_at_bytes(spark):
    got = _one(spark, "é" * 10, lambda c: X.strip_html(c, 5))
    assert got == "éé"


def test_words_and_chunks(spark):
    assert _one(spark, " B\x1fa  ", X.words) == ["b", "a"]
    text = " ".join(map(str, range(300)))
    got = spark.createDataFrame([(text,)], "v string").select(X.words(F.col("v")).alias("w")).select(X.chunks(F.col("w"))).first()[0]
    assert [c.split()[0] for c in got] == ["0"] and len(got[0].split()) == 256  # the tail has no full stride
    assert _one(spark, "", lambda c: X.chunks(X.words(c))) == [""]


def test_shingles_of_short_text(spark):
    df = spark.createDataFrame([("a b c",), ("",), (" ".join("abcdefghij"),)], "v string").select(X.words(F.col("v")).alias("w"))
    assert [len(r[0]) for r in df.select(X.shingle_hashes(F.col("w"))).collect()] == [1, 0, 3]


@pytest.mark.parametrize(
    "url,want",
    [("HTTP://Ex.COM/A?B#c", "http://ex.com/A?B"), ("https://e.com", "https://e.com"), ("https://E.com?Q=1", "https://e.com?Q=1"), ("mailto:X", "mailto:X"), ("https://e.com:8080/p#", "https://e.com:8080/p")],
)
def test_normalize(spark, url, want):
    assert _one(spark, url, U.normalize) == want


def test_same_domain_counts_the_port(spark):
    df = spark.createDataFrame([("http://A.com:80/x", "http://a.com/y"), ("http://A.com/x", "https://a.COM/y")], "a string, b string")
    assert [r[0] for r in df.select(U.same_domain(F.col("a"), F.col("b"))).collect()] == [False, True]


@pytest.mark.parametrize(
    "url,page,want",
    [
        ("https://e.com/r?page=1", 1, "https://e.com/r?page=2"),
        ("https://e.com/r?page=3", 1, None),
        ("https://e.com/r?q=a+b&p=2&q=c", 2, "https://e.com/r?q=a+b&p=3"),
        ("https://e.com/blog/page/4/", 4, "https://e.com/blog/page/5/"),
        ("https://e.com/pag2", 2, "https://e.com/pag3"),
        ("https://e.com/r?page=x", 1, None),
        ("https://e.com/", 1, None),
    ],
)
def test_next_page(spark, url, page, want):
    assert U.next_page(url, [], page) == want
    row = spark.createDataFrame([(url, page)], "u string, p int").select(U.next_page_url("u", F.array().cast("array<string>"), "p")).first()
    assert row[0] == want


def test_next_page_prefers_marked_links():
    assert U.next_page("https://e.com/?page=1", ["https://e.com/a", "https://e.com/b#Next"], 1) == "https://e.com/b#Next"
    assert U.next_page("https://e.com/?page=1", ["https://e.com/b#nextish"], 1) == "https://e.com/?page=2"


def test_native_increments_equal_the_exact_ones(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        n = rng.randrange(1, 4)
        rows.append((rng.choice(["https://e.com/list", "https://e.com/page", "https://e.com/x/page/"]) + rng.choice(["", str(n), f"{n}/"]) + rng.choice(["", "?a=1", f"?page={n}", f"?a=1&page={n}"]), rng.randrange(1, 4)))
    df = spark.createDataFrame(rows, "u string, p int")
    for r in df.select("u", "p", U.inc_path(F.col("u"), F.col("p")).alias("path"), U.inc_simple_param(F.col("u"), F.col("p")).alias("param")).collect():
        assert r.path == U.raise_path(r.u, r.p), r
        assert r.param == U.raise_param(r.u, r.p), r


def test_page_urls_and_detection(spark):
    assert U.page_urls("https://e.com/?page=1", 4) == [f"https://e.com/?page={n}" for n in (2, 3, 4)]
    assert U.page_urls("https://e.com/", 4) == []
    links = ["https://e.com/a?page=2", "https://o.com/?page=2", "https://e.com/page/3", "https://e.com/?page=", "https://e.com/b"]
    got = spark.createDataFrame([(links, "https://E.com/")], "l array<string>, b string").select(U.detect_pagination(F.col("l"), F.col("b"))).first()[0]
    assert got == [links[0], links[2]]
