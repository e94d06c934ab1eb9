"""Web-page relevance analytics on PySpark DataFrames."""

from pagequarry.api import acrawl, adeep_search, ajs_crawl, asearch_and_crawl, astream, crawl, deep_search, js_crawl, search_and_crawl
from pagequarry.functions.html import extract_and_merge, extract_structured, parse, parse_many
from pagequarry.functions.text import chunks, query_tokens, shingle_hashes, strip_html, tokens
from pagequarry.functions.urls import build_page_urls, cache_key, detect_pagination, next_page_url, normalize, same_domain
from pagequarry.operators.cache import PageCache
from pagequarry.operators.crawl import CrawlLimits, deep_crawl
from pagequarry.operators.dedup import SeenState, filter_duplicates
from pagequarry.operators.rank import keyword_score, rank, semantic_score
from pagequarry.progress import Event, Progress
from pagequarry.sinks import save, to_csv, to_dicts, to_json, to_markdown, to_sqlite, to_text
from pagequarry.sources.fetch import FetchOptions, Pacer, fetch, fetch_pages
from pagequarry.sources.providers import render, search_urls, snapshot, snapshot_source
from pagequarry.sources.robots import RobotsRules
from pagequarry.sources.sitemap import sitemap_frame, sitemap_urls

__version__ = "0.1.0"
__all__ = [n for n in dir() if not n.startswith("_")]
