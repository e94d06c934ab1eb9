"""From urls or a search to ranked pages."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions.html import parse_many
from pagequarry.operators.cache import PageCache
from pagequarry.operators.crawl import CrawlLimits, PageSource, deep_crawl
from pagequarry.operators.rank import Encoder, check_rank_arguments, rank
from pagequarry.sources.fetch import FetchOptions, Transport, fetch, fetch_pages, http_get, validate_urls
from pagequarry.sources.providers import Renderer, SearchProvider, render, search_urls
from pagequarry.staging import staged
from pagequarry.streaming.stream import ranked_alone


def crawl(spark: SparkSession, urls: list[str], query: str, top_k: int | None = None, mode: str = "both", semantic_weight: float = 0.5, options: FetchOptions | None = None, min_text_length: int = 0, encoder: Encoder | None = None, get: Transport = http_get, cache: PageCache | None = None, progress=None) -> DataFrame:
    """Fetch, parse, rank. Fetched pages are staged, so that scoring never fetches again."""
    check_rank_arguments(query, mode, semantic_weight)
    if progress:
        progress.start(len(urls))
    raw = staged(fetch(spark, urls, options, get, cache), "raw")
    if progress:
        progress.fetched_many(raw.count())
        progress.done()
    return rank(parse_many(raw, min_text_length), query, top_k, mode, semantic_weight, encoder)


def deep_search(spark: SparkSession, urls: list[str], query: str, limits: CrawlLimits | None = None, top_k: int | None = None, mode: str = "both", semantic_weight: float = 0.5, options: FetchOptions | None = None, encoder: Encoder | None = None, source: PageSource | None = None, get: Transport = http_get, progress=None, cache: PageCache | None = None) -> DataFrame:
    """Crawl in waves from the seeds, then rank. ``source`` replaces fetching, for instance by a snapshot."""
    check_rank_arguments(query, mode, semantic_weight)
    validate_urls(urls)
    pages = deep_crawl(spark, urls, source or (lambda u: fetch_pages(u, options, get, cache=cache)), limits, progress)
    return rank(staged(pages, "crawled"), query, top_k, mode, semantic_weight, encoder)


def search_and_crawl(spark: SparkSession, query: str, provider: SearchProvider | None, max_results: int = 10, news: bool = False, region: str = "wt-wt", safesearch: str = "off", timelimit: str | None = None, **crawl_arguments) -> DataFrame:
    """Search, then crawl what was found."""
    found = [r.url for r in search_urls(spark, provider, query, max_results, region, safesearch, timelimit, news).orderBy("ord").collect()]
    if not found:
        return spark.createDataFrame([], "ord long, url string, relevance_score double")
    return crawl(spark, found, query, **crawl_arguments)


def js_crawl(spark: SparkSession, urls: list[str], query: str, top_k: int | None = None, mode: str = "both", semantic_weight: float = 0.5, min_text_length: int = 0, encoder: Encoder | None = None, renderer: Renderer | None = None, max_concurrent: int = 3, **settings) -> DataFrame:
    """Render in a browser, parse, rank; no cache and no robots."""
    check_rank_arguments(query, mode, semantic_weight)
    raw = staged(render(spark, urls, renderer, max_concurrent, **settings), "rendered")
    return rank(parse_many(raw, min_text_length), query, top_k, mode, semantic_weight, encoder)


def _in_thread(call: Callable[..., DataFrame]):
    async def run(*args, **kwargs) -> DataFrame:
        return await asyncio.to_thread(call, *args, **kwargs)

    run.__doc__ = f"``{call.__name__}`` without blocking the event loop."
    return run


acrawl, adeep_search, asearch_and_crawl, ajs_crawl = map(_in_thread, (crawl, deep_search, search_and_crawl, js_crawl))


async def astream(spark: SparkSession, urls: list[str], query: str, mode: str = "both", semantic_weight: float = 0.5, options: FetchOptions | None = None, min_text_length: int = 0, get: Transport = http_get) -> AsyncIterator[dict]:
    """Rows as their partitions complete, each ranked by itself."""
    check_rank_arguments(query, mode, semantic_weight)
    rows = ranked_alone(parse_many(fetch(spark, urls, options, get), min_text_length), mode, semantic_weight)
    parts = rows.withColumn("__part", F.spark_partition_id()).toLocalIterator(prefetchPartitions=True)
    while (row := await asyncio.to_thread(next, parts, None)) is not None:
        out = row.asDict(recursive=True)
        out.pop("__part")
        yield out
