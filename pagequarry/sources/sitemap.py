"""Sitemaps: discovery, indexes, compressed files, and native parsing of sitemap tables."""

from __future__ import annotations

import gzip
import xml.etree.ElementTree as ET
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagequarry.sources.fetch import HEADERS, FetchError, Transport, http_get

_LOC = "{http://www.sitemaps.org/schemas/sitemap/0.9}loc"
USUAL_PLACES = tuple(f"/{p}.xml" for p in ("sitemap", "sitemap_index", "sitemap/sitemap"))
MAX_URLS = 10_000


def locations(xml: str) -> list[str]:
    """The namespaced loc texts; none for malformed XML."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    return [e.text.strip() for e in root.iter(_LOC) if e.text]


@F.arrow_udf(ArrayType(StringType()))
def sitemap_locations(xml: pa.Array) -> pa.Array:
    return pa.array([locations(x or "") for x in xml.to_pylist()], pa.list_(pa.string()))


def is_index(xml: Column) -> Column:
    return xml.contains("<sitemapindex")


def inflate(body: bytes | None, url: str, encoding: str | None) -> str:
    body = body or b""
    if encoding == "gzip" or url.endswith(".gz"):
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            pass
    return body.decode("utf-8", "ignore")


@F.arrow_udf(StringType())
def gunzip(body: pa.Array, url: pa.Array, encoding: pa.Array) -> pa.Array:
    """Text of a fetched body, inflated where its name or encoding says so; what isn't gzip stays."""
    return pa.array([inflate(b, u or "", e) for b, u, e in zip(body.to_pylist(), url.to_pylist(), encoding.to_pylist())], pa.string())


def robots_sitemaps(body: Column) -> Column:
    """The addresses of a robots.txt's sitemap lines."""
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda s: F.lower(s).startswith("sitemap:"))
    return F.filter(F.transform(lines, lambda s: F.trim(F.substr(s, F.lit(9)))), lambda u: u != "")


def site_root(url: str) -> str:
    p = urlparse(url)
    return f"{p.scheme}://{p.netloc}"


def sitemap_urls(base_url: str, max_urls: int = MAX_URLS, timeout: float = 10, get: Transport = http_get) -> list[str]:
    """Distinct page urls of a site's sitemaps, in order of discovery."""
    fetch = _reader(get, timeout)
    root = site_root(base_url)
    try:
        root = site_root(get(root + "/", headers=HEADERS, timeout=5).url)
    except FetchError:
        pass
    todo = [line.split(":", 1)[1].strip() for line in (fetch(root + "/robots.txt") or "").splitlines() if line.lower().startswith("sitemap:")]
    todo = [u for u in todo if u] or [root + p for p in USUAL_PLACES]
    seen: set[str] = set()
    found: list[str] = []
    while todo and len(found) < max_urls:
        later: list[str] = []
        for u in todo:
            if u in seen or len(found) >= max_urls:
                continue
            seen.add(u)
            xml = fetch(u)
            if xml:
                (later if "<sitemapindex" in xml else found).extend(locations(xml)[: None if "<sitemapindex" in xml else max_urls - len(found)])
        todo = later
    return list(dict.fromkeys(found))[:max_urls]


def _reader(get: Transport, timeout: float) -> Callable[[str], str | None]:
    def read(url: str) -> str | None:
        try:
            r = get(url, headers=HEADERS, timeout=timeout)
        except FetchError:
            return None
        return inflate(r.body, url, r.headers.get("content-encoding")) if r.status == 200 else None

    return read


def sitemap_frame(spark: SparkSession, base_url: str, max_urls: int = MAX_URLS, timeout: float = 10, get: Transport = http_get) -> DataFrame:
    """(ord, url) of a site's sitemaps."""
    return spark.createDataFrame(list(enumerate(sitemap_urls(base_url, max_urls, timeout, get))), "ord long, url string")


def urls_of(sitemaps: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """(ord, url): distinct urls of a table of urlset texts (ord, xml), first seen first."""
    each = sitemaps.where(~is_index(F.col("xml"))).select("ord", F.posexplode(sitemap_locations("xml")).alias("pos", "url"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("ord", "pos"))).where("n = 1")
    return first.orderBy("ord", "pos").limit(max_urls).select(F.monotonically_increasing_id().alias("ord"), "url")
