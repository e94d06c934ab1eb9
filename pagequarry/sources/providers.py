"""Pluggable sources that need outside services: web search and browser rendering, and the page snapshot."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pagequarry.schemas import RAW_PAGE
from pagequarry.sources.fetch import FetchError, validate_urls


class SearchProvider(Protocol):
    def text(self, query: str, max_results: int, region: str, safesearch: str, timelimit: str | None) -> list[dict]: ...

    def news(self, query: str, max_results: int, region: str, safesearch: str, timelimit: str | None) -> list[dict]: ...


def search_urls(spark: SparkSession, provider: SearchProvider | None, query: str, max_results: int = 10, region: str = "wt-wt", safesearch: str = "off", timelimit: str | None = None, news: bool = False) -> DataFrame:
    """(ord, url) of a provider's results; news is limited to a week unless told otherwise."""
    if provider is None:
        raise ImportError("no search provider: pass one with text() and news()")
    if news:
        rows = [r.get("url") for r in provider.news(query, max_results, region, safesearch, timelimit or "w")]
    else:
        rows = [r.get("href") for r in provider.text(query, max_results, region, safesearch, timelimit)]
    return spark.createDataFrame(list(enumerate(u for u in rows if u)), "ord long, url string")


RENDERED = StructType([*RAW_PAGE.fields, StructField("js_rendered", BooleanType())])
#: url, settings -> (final url, status, html)
Renderer = Callable[[str, dict], tuple[str, int, str]]


def browser_available() -> bool:
    return importlib.util.find_spec("playwright") is not None


def browser(url: str, settings: dict) -> tuple[str, int, str]:
    """Headless Chromium, where it is installed."""
    from playwright.sync_api import Error, sync_playwright

    with sync_playwright() as p:
        b = p.chromium.launch(proxy={"server": settings["proxy"]} if settings.get("proxy") else None)
        try:
            page = b.new_context(user_agent=settings.get("user_agent")).new_page()
            if settings.get("block_resources", True):
                page.route("**/*", lambda r: r.abort() if r.request.resource_type in ("image", "media", "font", "stylesheet") else r.continue_())
            answer = page.goto(url, wait_until=settings.get("wait_until", "networkidle"), timeout=settings.get("timeout_ms", 30000))
            if settings.get("wait_for_selector"):
                try:
                    page.wait_for_selector(settings["wait_for_selector"], timeout=settings.get("timeout_ms", 30000))
                except Error:
                    pass  # the page counts as it is
            if settings.get("extra_wait_ms"):
                page.wait_for_timeout(settings["extra_wait_ms"])
            return page.url, answer.status if answer else 200, page.content()
        except Error as e:
            raise FetchError(str(e)) from e
        finally:
            b.close()


def render_pages(urls: DataFrame, renderer: Renderer | None = None, max_concurrent: int = 3, **settings) -> DataFrame:
    """Raw pages after rendering, at most so many at a time; js_rendered is true for the successful ones."""
    if renderer is None:
        renderer = browser if browser_available() else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for o, u in zip(f.ord, f.url):
                try:
                    if renderer is None:
                        raise FetchError("no browser is installed")
                    final, status, html = renderer(u, settings)
                    rows.append((o, final, u, status, html, {}, None, True))
                except FetchError as e:
                    rows.append((o, u, u, None, None, {}, str(e), None))
            yield pd.DataFrame(rows, columns=RENDERED.names).astype({"status": "Int32", "js_rendered": "object"})

    return urls.select("ord", "url").repartition(max_concurrent).mapInPandas(run, RENDERED)


def render(spark: SparkSession, urls: list[str], renderer: Renderer | None = None, max_concurrent: int = 3, **settings) -> DataFrame:
    validate_urls(urls)
    return render_pages(spark.createDataFrame(list(enumerate(urls)), "ord long, url string"), renderer, max_concurrent, **settings)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (page_id, url, html) as fetched pages: status 200, no error."""
    pages = spark.read.parquet(path)
    return pages.select(F.col("page_id").alias("ord"), "url", F.col("url").alias("original_url"), F.lit(200).alias("status"), "html", F.create_map().cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("error"))


def snapshot_source(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A page source for crawls that answers from a table of raw pages, by url."""

    def source(urls: DataFrame) -> DataFrame:
        have = pages.select(F.col("url").alias("__u"), "html", "error")
        found = urls.join(have, F.col("url") == F.col("__u"), "left")
        return found.select("ord", "url", "html", F.when(F.col("__u").isNull(), "not in the snapshot").otherwise(F.col("error")).alias("error"))

    return source
