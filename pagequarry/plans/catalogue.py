"""Queries over the driver's tables, and their SQL.

Every query reads its whole tables. Where a reference operator works on inputs that the
tables lack (robots bodies, sitemaps, content types), they are made from the rows.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import tempfile
import zlib
from collections.abc import Callable
from contextlib import closing

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry import sinks
from pagequarry.functions import html as H
from pagequarry.functions import text as X
from pagequarry.functions import urls as U
from pagequarry.operators import cache, crawl, dedup, pacing, rank
from pagequarry.sources import fetch, providers, robots, sitemap
from pagequarry.staging import spread, stage_path, staged
from pagequarry.streaming import stream

QUERY = "thing ther reading thing tion"
PROXIES = ("http://p0:8080", "http://p1:8080", "http://p2:8080")
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _wide(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that is heavy by the row: over all task slots also where it is one file."""
    return spread(_t(spark, sf, name))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: len(t) >= {X.MIN_TOKEN} AND NOT list_contains({_STOP}, t))"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '')"
_AUTHORITY = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_ROOT = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)"


# ---- sources


@_query("SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) IN ('http', 'https') AS valid FROM pages")
def src_validate_urls(spark, sf):
    return _t(spark, sf, "pages").select("page_id", "url", U.is_valid(F.col("url")).alias("valid"))


@_query("SELECT page_id AS ord, url, url AS original_url, 200 AS status, md5(html) AS html_md5, CAST(NULL AS VARCHAR) AS error FROM pages")
def src_snapshot(spark, sf):
    return providers.snapshot(spark, f"{sf}/pages.parquet").select("ord", "url", "original_url", "status", F.md5("html").alias("html_md5"), "error")


@_query(f"SELECT page_id, url, [{', '.join(repr(p) for p in PROXIES)}][page_id % {len(PROXIES)} + 1] AS proxy FROM pages")
def src_proxy_rotation(spark, sf):
    return pacing.assign_proxy(_t(spark, sf, "pages").select("page_id", "url"), list(PROXIES), "page_id")


_CHARS = "length(html) / 100000.0"


@_query(f"""
WITH d AS (SELECT page_id, {_AUTHORITY} AS domain, {_CHARS} AS duration FROM pages)
SELECT page_id, domain, round(duration, 6) AS duration,
       round(coalesce(sum(greatest(duration, 0.05)) OVER (PARTITION BY domain ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start
FROM d""")
def src_rate_limited(spark, sf):
    d = _t(spark, sf, "pages").select("page_id", U.authority(F.col("url")).alias("domain"), (F.length("html") / 100000.0).alias("duration"))
    return pacing.sequential_schedule(d, 20.0, "page_id", ["domain"]).select("page_id", "domain", F.round("duration", 6).alias("duration"), F.round("start", 6).alias("start"))


_STATUS = "CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 404 WHEN 4 THEN 503 END"


@_query(f"""
WITH a AS (SELECT event_id, {_STATUS} AS status, CAST(event_id % 3 + 1 AS INTEGER) AS attempt FROM events)
SELECT *, attempt < 3 AND (status IS NULL OR status IN (429, 500, 502, 503, 504)) AS retry,
       CASE WHEN attempt < 3 AND (status IS NULL OR status IN (429, 500, 502, 503, 504)) THEN pow(1.5, attempt) END AS wait FROM a""")
def src_retry_policy(spark, sf):
    a = _t(spark, sf, "events").select("event_id", F.expr(_STATUS).alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"))
    return pacing.retry_plan(a)


_TYPE = "CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' Application/PDF ; q=1' WHEN 2 THEN 'image/png' WHEN 3 THEN '' END"


@_query(f"""
WITH p AS (SELECT page_id, lower(trim(split_part(coalesce({_TYPE}, ''), ';', 1))) AS kind FROM pages)
SELECT page_id, CASE WHEN kind IN ({", ".join(repr(t) for t in fetch.BINARY_TYPES)}) THEN 'skipped content-type: ' || kind END AS error FROM p""")
def src_content_type_filter(spark, sf):
    return _t(spark, sf, "pages").select("page_id", fetch.content_type_error(F.expr(_TYPE)).alias("error"))


_ROBOTS = "'User-agent: *' || chr(10) || 'Disallow: /de/' || chr(10) || 'Crawl-delay: 2' || chr(10) || 'Sitemap: https://' || domain || '/map.xml' || chr(10) || 'sitemap:' || chr(10) || 'SITEMAP:  http://' || domain || '/b.xml'"


def _robots_table(spark, sf):
    hosts = _t(spark, sf, "pages").select(U.authority(F.col("url")).alias("domain")).distinct()
    return hosts.where(F.length("domain") % 2 == 0).select("domain", F.expr(_ROBOTS).alias("body"))


@_query(f"""
WITH p AS (SELECT page_id, {_AUTHORITY} AS domain, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, NOT (len(domain) % 2 = 0 AND starts_with(path, '/de/')) AS allowed, CASE WHEN len(domain) % 2 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS crawl_delay FROM p""")
def robots_is_allowed(spark, sf):
    return robots.with_rules(_t(spark, sf, "pages").select("page_id", "url"), _robots_table(spark, sf)).drop("url")


@_query(f"""
WITH h AS (SELECT DISTINCT {_AUTHORITY} AS domain FROM pages)
SELECT domain, unnest(['https://' || domain || '/map.xml', 'http://' || domain || '/b.xml']) AS sitemap FROM h WHERE len(domain) % 2 = 0""")
def sitemap_from_robots(spark, sf):
    return _robots_table(spark, sf).select("domain", F.explode(sitemap.robots_sitemaps(F.col("body"))).alias("sitemap"))


_XML = "'<?xml version=\"1.0\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url><url><loc>https://x.example/' || (page_id % 50) || '</loc></url></urlset>'"


@_query("SELECT DISTINCT u AS url FROM (SELECT unnest([trim(url), 'https://x.example/' || (page_id % 50)]) AS u FROM pages)")
def sitemap_parse_urlset(spark, sf):
    xml = _t(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.expr(_XML).alias("xml"))
    return sitemap.urls_of(xml, 2147483647).select("url")


@_query("SELECT page_id, page_id % 3 = 0 AS is_index FROM pages")
def sitemap_is_index(spark, sf):
    xml = F.when(F.col("page_id") % 3 == 0, "<sitemapindex xmlns='x'/>").otherwise("<urlset/>")
    return _t(spark, sf, "pages").select("page_id", sitemap.is_index(xml).alias("is_index"))


@_query(f"SELECT page_id, {_ROOT} AS base FROM pages")
def sitemap_base(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.base(F.col("url")).alias("base"))


# ---- HTML to columns


@_query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ' || chr(0)) AS text FROM pages")
def strip_html(spark, sf):
    return _wide(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@_query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS text FROM documents")
def clean_text(spark, sf):
    return _wide(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


@_query("SELECT page_id, CASE WHEN regexp_matches(html, '<html[^>]* lang=') THEN lower(split_part(regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1), '-', 1)) END AS language FROM pages")
def extract_language(spark, sf):
    return H.parse(_wide(spark, sf, "pages")).select("page_id", "language")


@_query(r"SELECT page_id, trim(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS title FROM pages".replace('\\"', '"'))
def extract_title(spark, sf):
    return H.parse(_wide(spark, sf, "pages")).select("page_id", "title")


@_query()
def parse(spark, sf):
    return H.parse(_wide(spark, sf, "pages")).select("page_id", "url", "title", "text", "links", F.map_entries("meta").alias("meta"), "language")


@_query()
def parse_many(spark, sf):
    return H.parse_many(spread(providers.snapshot(spark, f"{sf}/pages.parquet"))).select("ord", "url", "title", F.length("text").alias("n_chars"), F.size("links").alias("n_links"))


@_query()
def extract_structured(spark, sf):
    s = _wide(spark, sf, "pages").select("page_id", H.extract_structured("html").alias("s"))
    return s.select("page_id", F.map_entries("s.open_graph").alias("open_graph"), F.map_entries("s.twitter_card").alias("twitter_card"), "s.json_ld", F.size("s.tables").alias("n_tables"), "s.lists", "s.canonical", "s.favicon")


# ---- tokens, shingles, urls


@_query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)")
def tokenize(spark, sf):
    t = X.tokens(F.col("text"))
    return _wide(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "t")).alias("tokens_md5"))


@_query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token")
def term_frequency(spark, sf):
    return _wide(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@_query(f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS token FROM documents) GROUP BY token")
def document_frequency(spark, sf):
    return rank.document_frequency(_wide(spark, sf, "documents").select(X.tokens(F.col("text")).alias("tokens")))


_SHINGLES = f"""
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {X.SHINGLE_WORDS - 1}], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {X.SHINGLE_WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0))"""


@_query(f"WITH {_SHINGLES} SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id")
def shingles(spark, sf):
    return dedup.fingerprints(_wide(spark, sf, "documents"), "doc_id").select(F.col("id").alias("doc_id"), F.size("fp").cast("long").alias("n_shingles"))


@_query(r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) || substr(regexp_replace(url, '#.*$', ''), len(regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) + 1) AS url FROM pages")
def url_normalize(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.normalize(F.col("url")).alias("url"))


@_query(f"SELECT page_id, {_AUTHORITY} AS domain FROM pages")
def url_domain(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.authority(F.col("url")).alias("domain"))


@_query(f"SELECT {_AUTHORITY} AS domain, count(*) AS n FROM pages GROUP BY ALL")
def pages_per_domain(spark, sf):
    return _t(spark, sf, "pages").groupBy(U.authority(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


_HREFS = r"""regexp_extract_all(html, '<a [^>]*href="(https?://[^"]*)"', 1)"""


def _href_lists(spark, sf):
    return _t(spark, sf, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit('<a [^>]*href="(https?://[^"]*)"'), F.lit(1)).alias("links"))


@_query(rf"SELECT page_id, len(list_filter({_HREFS}, lambda u: lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) = {_AUTHORITY})) AS n_same FROM pages")
def same_domain(spark, sf):
    return _href_lists(spark, sf).select("page_id", F.size(F.filter("links", lambda u: U.same_domain(u, F.col("url")))).cast("long").alias("n_same"))


@_query("SELECT page_id, 'v1:' || sha256(url) AS key FROM pages")
def cache_key(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.cache_key(F.col("url")).alias("key"))


# ---- pagination


@_query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '[?&]page=(\d+)(&|#|$)', 1) AS n, regexp_extract(url, '^(.*[?&]page=)\d+', 1) AS a, regexp_extract(url, '[?&]page=\d+(.*)$', 1) AS b FROM pages)
SELECT page_id, CASE WHEN n = '2' THEN a || '3' || b END AS next FROM p""")
def inc_query_param_simple(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.inc_simple_param(F.col("url"), F.lit(2)).alias("next"))


@_query()
def inc_query_param(spark, sf):
    return _t(spark, sf, "pages").select("page_id", U.inc_query_param("url", F.lit(2)).alias("next"))


@_query(rf"SELECT page_id, {_ROOT} || '/list/page/' || (page_id % 4 + 1) || '/?a=1' AS next FROM pages")
def inc_path(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.concat(U.base(F.col("url")), F.lit("/list/page/"), (F.col("page_id") % 4).cast("string"), F.lit("/?a=1")).alias("url"))
    return p.select("page_id", U.inc_path(F.col("url"), F.col("page_id") % 4).alias("next"))


_MADE_LINKS = f"[{_ROOT} || '/list?page=' || (page_id % 9), {_ROOT} || '/post/page/' || page_id || '/', {_ROOT} || '/about', {_ROOT} || '/a?q=1&PG=#x', 'https://x.example/?page=2', {_ROOT} || '/x?start=' || page_id || '#page']"


def _made_links(spark, sf):
    """The pages' own links lie in their navigation, which parsing leaves out; these are made from the rows."""
    root, n = U.base(F.col("url")), F.col("page_id").cast("string")
    links = F.array(F.concat(root, F.lit("/list?page="), (F.col("page_id") % 9).cast("string")), F.concat(root, F.lit("/post/page/"), n, F.lit("/")), F.concat(root, F.lit("/about")), F.concat(root, F.lit("/a?q=1&PG=#x")), F.lit("https://x.example/?page=2"), F.concat(root, F.lit("/x?start="), n, F.lit("#page")))
    return _t(spark, sf, "pages").select("page_id", "url", links.alias("links"))


@_query(rf"""SELECT page_id, unnest(list_filter({_MADE_LINKS}, lambda u: lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) = {_AUTHORITY}
 AND (regexp_matches(u, '(?i)/page?/?\d+/?$') OR regexp_matches(regexp_extract(u, '^([^#]*)', 1), '(?i)[?&](?:{U.PAGE_KEYS})=[^&#]')))) AS link FROM pages""")
def detect_pagination_links(spark, sf):
    return _made_links(spark, sf).select("page_id", F.explode(U.detect_pagination(F.col("links"), F.col("url"))).alias("link"))


@_query(rf"SELECT page_id, {_ROOT} || '/l?page=' || n AS url FROM pages, (VALUES (2), (3), (4), (5)) AS v(n)")
def build_page_urls(spark, sf):
    first = F.concat(U.base(F.col("url")), F.lit("/l?page=1"))
    return _t(spark, sf, "pages").select("page_id", first.alias("f")).select("page_id", F.explode(U.build_page_urls("f", F.lit(5))).alias("url"))


@_query(rf"SELECT page_id, {_ROOT} || '/s?p=3&q=a' AS next FROM pages")
def next_page_url(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.concat(U.base(F.col("url")), F.lit("/s?p=2&q=a")).alias("u"))
    return p.select("page_id", U.next_page_url("u", F.array().cast("array<string>"), F.lit(2)).alias("next"))


# ---- deduplication


_NEAR = f"""{_SHINGLES},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {dedup.THRESHOLD})"""


@_query(f"WITH {_NEAR} SELECT a, b, round(jaccard, 6) AS jaccard FROM near")
def dedup_content(spark, sf):
    pages = _wide(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.similar_pairs(pages).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@_query(f"""
WITH RECURSIVE {_NEAR},
late AS (SELECT b AS id, list(a) AS before, row_number() OVER (ORDER BY b) AS k FROM near GROUP BY b),
walk(k, gone) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL SELECT l.k, CASE WHEN len(list_filter(l.before, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, l.id) ELSE w.gone END
  FROM walk w JOIN late l ON l.k = w.k + 1)
SELECT doc_id AS ord FROM documents WHERE doc_id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1))""")
def dedup_filter(spark, sf):
    return dedup.filter_duplicates(_docs(spark, sf)).select("ord")


@_query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1 OR coalesce(url, '') = ''")
def dedup_url(spark, sf):
    return dedup.first_of_each_url(_t(spark, sf, "pages").select("page_id", "url"), "page_id")


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def dedup_seen(spark, sf):
    ids = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("url"))
    seen = _t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("url"))
    return dedup.drop_seen_urls(ids, seen).select(F.col("url").cast("long").alias("doc_id"))


@_query(f"""
WITH w AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS t FROM conversations),
p AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
SELECT conv_id, turn, round(CASE WHEN len(t) = 0 OR len(coalesce(b, [])) = 0 THEN 0 ELSE len(list_intersect(t, b)) / (len(t) + len(b) - len(list_intersect(t, b))) END, 6)::DOUBLE AS jaccard FROM p""")
def jaccard(spark, sf):
    t = _t(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(X.tokens(F.col("text"))).alias("t"))
    p = t.withColumn("b", F.coalesce(F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>")))
    return p.select("conv_id", "turn", F.round(dedup.jaccard(F.col("t"), F.col("b")), 6).alias("jaccard"))


# ---- relevance


_TERMS = X.query_tokens(QUERY)
_BM25 = f"""
t AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
z AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM t) GROUP BY token),
i AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, z),
q AS (SELECT unnest([{", ".join(repr(t) for t in _TERMS)}]) AS token),
f AS (SELECT q.token, CASE WHEN i.idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE i.idf END AS idf FROM q JOIN i USING (token)),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM t) GROUP BY ALL),
b AS (SELECT t.doc_id, coalesce(sum(f.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(t.t) / z.avgdl))), 0) AS raw
      FROM t CROSS JOIN z LEFT JOIN tf ON tf.doc_id = t.doc_id LEFT JOIN f ON f.token = tf.token GROUP BY t.doc_id),
k AS (SELECT doc_id, raw, round(CASE WHEN max(raw) OVER () - min(raw) OVER () < 1e-9 THEN 0 ELSE (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()) END, 6) AS keyword_score FROM b)"""


@_query(f"WITH {_BM25} SELECT doc_id, round(raw, 6)::DOUBLE AS bm25 FROM b")
def bm25(spark, sf):
    return rank.bm25(_wide(spark, sf, "documents").select("doc_id", "text"), QUERY).select("doc_id", F.round("bm25", 6).alias("bm25"))


@_query(f"WITH {_BM25} SELECT doc_id, keyword_score::DOUBLE AS keyword_score FROM k")
def keyword_score(spark, sf):
    return rank.keyword_score(_wide(spark, sf, "documents").select("doc_id", "text"), QUERY).select("doc_id", "keyword_score")


@_query(f"WITH {_BM25} SELECT doc_id, keyword_score::DOUBLE AS relevance_score FROM k ORDER BY keyword_score DESC, doc_id LIMIT 20")
def rank_keyword_topk(spark, sf):
    rows = rank.rank(_wide(spark, sf, "documents").select("doc_id", "text"), QUERY, 20, "keyword", order="doc_id")
    return rows.select("doc_id", "relevance_score")


_PIVOT = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = f"list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_PIVOT} AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST({_PIVOT} AS DOUBLE[]), CAST({_PIVOT} AS DOUBLE[]))))"


def _cosines(spark, sf):
    e = _t(spark, sf, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", "label", rank.cosine(F.col("embedding"), F.col("q")).alias("cos"))


@_query(f"SELECT vec_id, round({_COS}, 6) AS cos FROM embeddings")
def cosine(spark, sf):
    return _cosines(spark, sf).select("vec_id", F.round("cos", 6).alias("cos"))


@_query(f"SELECT vec_id, round({_COS}, 6) AS cos FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    return rank.top(_cosines(spark, sf), 10, "vec_id", "cos").select("vec_id", F.round("cos", 6).alias("cos"))


@_query(f"WITH c AS (SELECT vec_id, {_COS} AS cos FROM embeddings) SELECT vec_id, round((cos - min(cos) OVER ()) / (max(cos) OVER () - min(cos) OVER ()), 6) AS scaled FROM c")
def minmax(spark, sf):
    return rank.minmax(_cosines(spark, sf), "cos", "scaled").select("vec_id", F.round("scaled", 6).alias("scaled"))


@_query(f"""
WITH {_BM25}, c AS (SELECT vec_id, {_COS} AS cos FROM embeddings),
s AS (SELECT vec_id, round((cos - min(cos) OVER ()) / (max(cos) OVER () - min(cos) OVER ()), 6) AS semantic_score FROM c)
SELECT doc_id, round(round(0.7 * keyword_score + 0.3 * semantic_score, 6), 5)::DOUBLE AS relevance_score FROM k JOIN s ON k.doc_id = s.vec_id""")
def rank_blend(spark, sf):
    k = rank.keyword_score(_wide(spark, sf, "documents").select("doc_id", "text"), QUERY).select("doc_id", "keyword_score")
    s = rank.minmax(_cosines(spark, sf), "cos", "semantic_score").select("vec_id", F.round("semantic_score", 6).alias("semantic_score"))
    both = rank.blend(k.join(s, F.col("doc_id") == F.col("vec_id")), "both", 0.3)
    return both.select("doc_id", rank.rounded(F.col("relevance_score"), 5).alias("relevance_score"))


@_query(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 256, 0) + 1, 128)) AS i FROM w)
SELECT doc_id, CAST(i // 128 AS INTEGER) AS chunk_no, md5(array_to_string(w[i + 1:i + 256], ' ')) AS chunk_md5 FROM c""")
def chunk_text(spark, sf):
    c = rank.chunk_texts(_wide(spark, sf, "documents"), "doc_id")
    return c.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


@_query("""
WITH x AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, max(v) AS v FROM x GROUP BY ALL""")
def max_pool(spark, sf):
    return rank.max_pool(_t(spark, sf, "embeddings"), "label", "embedding").select("label", F.posexplode("embedding").alias("i", "v"))


def hashed_words(texts: list[str], width: int = 32) -> np.ndarray:
    """A stand-in for a sentence encoder that needs no model: counts of words by a hash."""
    out = np.zeros((len(texts), width))
    for row, t in zip(out, texts):
        for w in t.lower().split():
            row[zlib.crc32(w.encode()) % width] += 1
    return out


@_query()
def semantic_score(spark, sf):
    pages = H.parse_many(spread(providers.snapshot(spark, f"{sf}/pages.parquet"))).select("ord", "text")
    return rank.semantic_score(staged(pages, "parsed"), QUERY, hashed_words).select("ord", "semantic_score")


@_query("SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN l.quality ELSE 0.5 END::DOUBLE AS score FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)")
def score_update(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.lit(0.5).alias("score"))
    new = _t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score")).distinct()
    return rank.update_scores(rows, new, "doc_id", "score")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best pages: parsed, scored by BM25, cut to the top."""
    pages = H.parse_many(spread(providers.snapshot(spark, f"{sf_dir}/pages.parquet"))).select("ord", "url", "title", "text", "language")
    return rank.rank(staged(pages, "parsed"), QUERY, 10, "keyword").select("ord", "url", "title", "language", "relevance_score")


@_query()
def crawl_and_rank(spark, sf):
    return flagship(spark, sf)


# ---- crawl dataflow


@_query(f"SELECT page_id, {_AUTHORITY} AS domain, count(*) OVER (PARTITION BY {_AUTHORITY} ORDER BY page_id) AS domain_count FROM pages QUALIFY domain_count <= 3")
def domain_cap(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", U.authority(F.col("url")).alias("domain"), F.lit(1).alias("kept"))
    return crawl.running_domain_counts(p, None, "domain", "page_id").where("domain_count <= 3").drop("kept")


@_query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100")
def max_pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", "url").orderBy("page_id").limit(100)


@_query(f"""
WITH l AS (SELECT unnest({_MADE_LINKS}) AS u, {_AUTHORITY} AS d FROM pages),
n AS (SELECT DISTINCT lower(regexp_extract(split_part(u, '#', 1), '^([A-Za-z]+://[^/?#]*)', 1)) || regexp_extract(split_part(u, '#', 1), '^[A-Za-z]+://[^/?#]*(.*)$', 1) AS url FROM l
      WHERE lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1)) = d)
SELECT url, 1 AS depth, 1 AS page_num FROM n""")
def expand_links(spark, sf):
    p = _made_links(spark, sf).select(F.col("page_id").alias("ord"), F.col("url").alias("requested"), "url", "links", F.lit(0).alias("depth"), F.lit(1).alias("page_num"))
    seen = p.select(U.normalize(F.col("requested")).alias("url"))
    return crawl.expand(p, seen, None, crawl.CrawlLimits(paginate=False, max_pages_per_domain=2147483647)).select("url", "depth", "page_num")


@_query(f"SELECT DISTINCT lower({_ROOT}) || '/s?p=4&q=' || (page_id % 50) AS url, 0 AS depth, 4 AS page_num FROM pages")
def expand_pagination(spark, sf):
    first = F.concat(U.base(F.col("url")), F.lit("/s?p=3&q="), (F.col("page_id") % 50).cast("string"))
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("ord"), first.alias("requested"), first.alias("url"), F.array().cast("array<string>").alias("links"), F.lit(0).alias("depth"), F.lit(3).alias("page_num"))
    return crawl.expand(p, p.select("url"), None, crawl.CrawlLimits(max_pages_per_domain=2147483647)).select("url", "depth", "page_num")


@_query()
def deep_crawl(spark, sf):
    # the first page of each url by its place in the files, so the html is only moved to the page that asks for it
    raw = _t(spark, sf, "pages").select(F.struct("_metadata.file_path", "_metadata.row_index").alias("row"), F.col("page_id").alias("ord"), U.normalize(F.col("url")).alias("url"), "html")
    site = raw.where(U.is_valid(F.col("url"))).groupBy("url").agg(F.min(F.struct("ord", "row")).alias("first"))
    site = staged(site.select("url", "first.*"), "site")
    seeds = site.select(F.row_number().over(Window.orderBy("ord", "url")).alias("ord"), "url")

    def source(urls):
        found = urls.join(site.select("url", "row"), "url", "left").join(raw.select("row", "html"), "row", "left")
        return found.select("ord", "url", "html", F.when(F.col("row").isNull(), "not in the snapshot").alias("error"))

    pages = crawl.deep_crawl(spark, seeds, source, crawl.CrawlLimits(depth=1, max_pages=None, max_pages_per_domain=2147483647))
    return pages.select("ord", "url", "title", "depth", "page_num")


# ---- state


def _entries(spark, sf):
    return _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("page"), "ts", "event_id")


@_query("""
WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS key, ts FROM l, m WHERE epoch(now) - epoch(ts) <= 86400""")
def cache_disk(spark, sf):
    e = _entries(spark, sf)
    now = e.agg(F.max("ts").alias("now"))
    return cache.latest(e).crossJoin(F.broadcast(now)).where(cache.is_fresh(F.col("ts"), F.col("now"), cache.DISK_TTL)).select("key", "ts")


@_query("SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, key LIMIT 512")
def cache_memory(spark, sf):
    return cache.evict(_entries(spark, sf))


@_query("""
WITH a AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, b IS NOT NULL AND epoch(ts) - epoch(b) <= 3600 AS hit FROM a""")
def cache_hits(spark, sf):
    e = _entries(spark, sf).withColumn("ts", F.col("ts"))
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return e.select("event_id", (before.isNotNull() & cache.is_fresh(before, F.col("ts"), 3600)).alias("hit"))


@_query("""
WITH m AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS url, CASE WHEN epoch(now) - epoch(ts) <= 3600 THEN 1 WHEN epoch(now) - epoch(ts) <= 86400 THEN 2 END AS tier FROM l, m""")
def cache_tiered(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("page"), "ts")
    entries = e.select(U.cache_key(F.col("url")).alias("key"), "page", "ts")
    urls = e.select("url").distinct().crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return cache.tiered_get(urls, entries, entries, F.col("now")).select("url", "tier")


@_query("""
WITH a AS (SELECT event_id, event_type, epoch(ts)::DOUBLE AS secs, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts)::DOUBLE, event_id) AS i FROM events)
SELECT event_id, round(max(secs - i * 20.0) OVER (PARTITION BY event_type ORDER BY secs, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 20.0, 3) AS start FROM a""")
def ratelimit(spark, sf):
    a = _t(spark, sf, "events").select("event_id", F.concat(F.lit("http://"), "event_type", F.lit("/")).alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a = a.withColumn("at", F.col("us") / 1e6).drop("us")
    return pacing.schedule(a, 0.05, order="event_id").select("event_id", F.round("start", 3).alias("start"))


_KIND = "CASE event_id % 5 WHEN 0 THEN 'cached' WHEN 1 THEN 'error' ELSE 'fetched' END"


@_query(f"""
WITH e AS (SELECT event_id, user_id, {_KIND} AS event FROM events),
c AS (SELECT event_id, count(*) OVER w AS done, count(*) FILTER (event = 'error') OVER w AS errors, count(*) FILTER (event = 'cached') OVER w AS cached FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT * FROM c""")
def progress(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", F.expr(_KIND).alias("event"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return pacing.progress(e, F.lit(100), ["user_id"], "event_id").select("event_id", "done", "errors", "cached")


# ---- sinks and streams


_REPORT = 100
_TOP = f"""WITH {_BM25}, r AS (
  SELECT row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS n, 'doc:' || doc_id AS url, keyword_score::DOUBLE AS s, lang, text
  FROM k JOIN documents USING (doc_id) ORDER BY n LIMIT {_REPORT})"""


def _report(spark, sf):
    """A top-k report as the sinks get it; they run on the driver, as their outputs are single files or strings."""
    d = _wide(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language"), F.concat(F.lit("doc:"), "doc_id").alias("url"), F.lit(None).cast("string").alias("title"))
    return rank.rank(d, QUERY, _REPORT, "keyword", order="doc_id")


@_query(f"{_TOP} SELECT url, s AS relevance_score, s AS keyword_score, lang AS language FROM r")
def sink_csv(spark, sf):
    rows = list(csv.DictReader(io.StringIO(sinks.to_csv(_report(spark, sf)), newline="")))
    return spark.createDataFrame([(r["url"], float(r["relevance_score"]), float(r["keyword_score"]), r["language"]) for r in rows], "url string, relevance_score double, keyword_score double, language string")


@_query(f"{_TOP} SELECT url, s AS relevance_score, md5(text) AS text_md5 FROM r")
def sink_json(spark, sf):
    rows = json.loads(sinks.to_json(_report(spark, sf)))
    return spark.createDataFrame([(r["url"], r["relevance_score"], r["text"]) for r in rows], "url string, relevance_score double, text string").select("url", "relevance_score", F.md5("text").alias("text_md5"))


@_query(f"""{_TOP} SELECT '[' || n || '] ' || url || chr(10) || '    Title     : N/A' || chr(10) || '    Language  : ' || lang || chr(10) || '    Relevance : ' || s || chr(10) || '    Keyword   : ' || s || chr(10)
 || '    Semantic  : N/A' || chr(10) || '    Preview   : ' || replace(left(text, 300), chr(10), ' ') || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS block FROM r""")
def sink_text(spark, sf):
    blocks = re.split(r"\n\n(?=\[\d+\] doc:)", sinks.to_text(_report(spark, sf)).rstrip("\n"))
    return spark.createDataFrame([(b,) for b in blocks], "block string")


@_query(f"""{_TOP} SELECT n || '. Untitled' AS heading, '- **URL**: [' || url || '](' || url || ')' AS url_line, '> ' || trim(replace(left(text, 500), chr(10), ' ') || CASE WHEN length(text) > 500 THEN '...' ELSE '' END) AS quote FROM r""")
def sink_markdown(spark, sf):
    parts = re.split(r"(?m)^## (?=\d+\. Untitled$)", sinks.to_markdown(_report(spark, sf)))[1:]
    rows = [(p.split("\n", 1)[0], re.search(r"^- \*\*URL\*\*: .*$", p, re.M)[0], re.search(r"^> .*$", p, re.M)[0]) for p in parts]
    return spark.createDataFrame(rows, "heading string, url_line string, quote string")


@_query(f"{_TOP} SELECT n AS id, url, s AS relevance_score, CAST(NULL AS DOUBLE) AS semantic_score, lang AS language, md5(text) AS text_md5 FROM r")
def sink_sqlite(spark, sf):
    with tempfile.TemporaryDirectory() as d:  # the driver's own file: SQLite has one writer
        sinks.to_sqlite(_report(spark, sf), f"{d}/pages.db")
        with closing(sqlite3.connect(f"{d}/pages.db")) as db:
            rows = db.execute("SELECT id, url, relevance_score, semantic_score, language, text FROM pages ORDER BY id").fetchall()
    return spark.createDataFrame(rows, "id long, url string, relevance_score double, semantic_score double, language string, text string").withColumn("text_md5", F.md5("text")).drop("text")


def _streamed(spark, stream_df, name: str) -> DataFrame:
    """A stream's rows once all that was there has gone through."""
    out, state = stage_path(spark, name), stage_path(spark, f"{name}-state")
    q = stream_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream_df.schema).parquet(out)


def _page_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/pages.parquet").schema
    return stream.read_pages(spark, f"{sf}/pages.parque[t]", schema)  # a pattern, as the table may be one file


@_query("SELECT DISTINCT url FROM pages")
def stream_first_seen(spark, sf):
    return _streamed(spark, stream.first_seen(_page_stream(spark, sf).select("url")), "first")


@_query("SELECT page_id, 0.0::DOUBLE AS relevance_score FROM pages")
def astream(spark, sf):
    p = _page_stream(spark, sf)
    ranked = stream.ranked_alone(H.parse_many(p.select("page_id", "url", "html")))
    return _streamed(spark, ranked.select("page_id", "relevance_score"), "alone")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
