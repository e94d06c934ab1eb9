import asyncio
import csv
import io
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from pagequarry import api, sinks
from pagequarry.operators import cache
from pagequarry.sources.fetch import Response
from pagequarry.sources.providers import snapshot
from pagequarry.streaming import stream

ROWS = [
    {"url": "http://a/", "title": 'T "q", x', "text": "a\nb" * 200, "relevance_score": 0.5, "keyword_score": 0.5, "semantic_score": None, "language": None, "structured": {"open_graph": {"description": "D", "image": "I"}}},
    {"url": "http://b/", "title": None, "text": None, "relevance_score": 0.25, "language": "en"},
]


def test_json_and_csv():
    assert json.loads(sinks.to_json([{"x": "é", "y": {1}}])) == [{"x": "é", "y": "{1}"}] and "é" in sinks.to_json([{"x": "é"}])
    rows = list(csv.reader(io.StringIO(sinks.to_csv(ROWS), newline="")))
    assert rows == [list(sinks.CSV_COLUMNS), ["http://a/", 'T "q", x', "0.5", "0.5", "", ""], ["http://b/", "", "0.25", "", "", "en"]]
    assert sinks.to_csv([]) == ""


def test_text_and_markdown():
    t = sinks.to_text(ROWS)
    assert t.startswith("[1] http://a/") and "Language  : N/A" in t and "Semantic  : N/A" in t and "..." in t and "[2] http://b/" in t
    m = sinks.to_markdown(ROWS)
    assert "## 1. T" in m and "OG Description**: D" in m and "OG Image**: I" in m and "## 2. Untitled" in m and "`unknown`" in m
    assert m.count("Semantic score") == 0 and m.count("Keyword score") == 1


def test_sqlite_appends(tmp_path):
    path = str(tmp_path / "d" / "x.db")
    assert sinks.to_sqlite(ROWS, path) == 2 and sinks.to_sqlite(ROWS[:1], path) == 1
    db = sqlite3.connect(path)
    assert db.execute("SELECT count(*), count(crawled_at) FROM pages").fetchone() == (3, 3)
    assert json.loads(db.execute("SELECT structured FROM pages WHERE id = 1").fetchone()[0])["open_graph"]["image"] == "I"
    assert db.execute("SELECT count(*) FROM sqlite_master WHERE type = 'index'").fetchone()[0] >= 2


def test_save(spark, tmp_path):
    sinks.save(ROWS, str(tmp_path / "n" / "a.csv"))
    assert (tmp_path / "n" / "a.csv").read_bytes().startswith(b"url,title")
    sinks.save(ROWS, str(tmp_path / "a.txt"), "json")
    json.loads((tmp_path / "a.txt").read_text())
    with pytest.raises(ValueError):
        sinks.save(ROWS, str(tmp_path / "a"), "xml")
    df = spark.createDataFrame([("http://a/", 0.5)], "url string, relevance_score double")
    sinks.save(df, str(tmp_path / "p.parquet"))
    assert spark.read.parquet(str(tmp_path / "p.parquet")).count() == 1
    assert sinks.to_dicts(df) == [{"url": "http://a/", "relevance_score": 0.5}]


def test_cache_tables(spark):
    e = spark.createDataFrame([("u", "old", 0), ("u", "new", 50), ("v", "x", 0)], "url string, page string, s long").withColumn("ts", F.timestamp_seconds("s"))
    entries = cache.put(spark.createDataFrame([], "key string, page string, ts timestamp"), e.where("url = 'v'"), F.timestamp_seconds(F.lit(0)))
    for s in (0, 50):
        entries = cache.put(entries, e.where(f"url = 'u' and s = {s}"), F.timestamp_seconds(F.lit(s)))
    urls = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    now = F.timestamp_seconds(F.lit(100))
    got = lambda df: {r.url: r.page for r in df.collect()}
    assert got(cache.get(urls, entries, now, 60)) == {"u": "new", "v": None, "w": None}
    assert got(cache.get(urls, entries, now, 0)) == {"u": "new", "v": "x", "w": None}
    assert got(cache.get(urls, cache.invalidate(entries, urls.where("url = 'u'")), now, 0))["u"] is None
    tiers = {r.url: (r.page, r.tier) for r in cache.tiered_get(urls, entries, entries, now, 60, 1000).collect()}
    assert tiers == {"u": ("new", 1), "v": ("x", 2), "w": (None, None)}


def test_lru_keeps_the_last_accessed(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "key string, ts long")
    assert sorted(r.key for r in cache.evict(a, 2).collect()) == ["a", "c"]


def pages(spark, path, rows):
    spark.createDataFrame(rows, "ord long, url string, html string, error string").coalesce(1).write.mode("append").parquet(path)


def test_rank_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    pages(spark, path, [(0, "u", "<p>fox fox</p>", None), (1, "v", "<p>dog</p>", None), (2, "w", None, "bad"), (3, "x", "<p>cat</p>", None)])  # in one of two pages a word's idf is 0
    schema = spark.read.parquet(path).schema
    for corpus, want in (("page", {"u": 0.0, "v": 0.0, "x": 0.0}), ("batch", {"u": 1.0, "v": 0.0, "x": 0.0})):
        got = []
        q = stream.rank_stream(stream.read_pages(spark, path, schema), "fox", lambda df, i, got=got: got.extend(df.collect()), str(tmp_path / corpus), corpus, "keyword")
        q.awaitTermination()
        assert {r.url: r.relevance_score for r in got} == want
    with pytest.raises(ValueError):
        stream.rank_stream(stream.read_pages(spark, path, schema), "fox", print, "x", "all")


def test_seen_streams_keep_state_between_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    pages(spark, path, [(0, "u", "a b", None)])
    schema = spark.read.parquet(path).schema
    for name, make in (("url", stream.first_seen), ("text", lambda s: stream.first_content(s.withColumn("text", F.col("html"))))):
        out, state = str(tmp_path / f"o-{name}"), str(tmp_path / f"s-{name}")
        for _ in range(2):
            make(stream.read_pages(spark, path, schema, 1)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
            if name == "url":
                pages(spark, path, [(1, "u", "A  b", None), (2, "v", "A  b", None)])
        got = sorted(r.ord for r in spark.read.parquet(out).collect())
        assert (name, len(got)) in (("url", 2), ("text", 1))


def test_astream_yields_zero_scores(spark):
    async def run():
        return [r async for r in api.astream(spark, ["http://a/", "http://b/"], "fox", mode="keyword", get=lambda url, **_: Response(200, url, {}, b"<p>fox</p>"))]

    rows = asyncio.run(run())
    assert sorted(r["url"] for r in rows) == ["http://a/", "http://b/"] and {r["relevance_score"] for r in rows} == {0.0}


def test_snapshot_is_raw_pages(spark, sf):
    r = snapshot(spark, f"{sf}/pages.parquet").first()
    assert r.status == 200 and r.error is None and r.headers == {}
