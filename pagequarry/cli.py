"""Command line: crawl, deep, search, js, sitemap."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from pagequarry import api, sinks
from pagequarry.operators.cache import DISK_TTL, PageCache
from pagequarry.operators.crawl import CrawlLimits
from pagequarry.progress import Progress
from pagequarry.sources.fetch import FetchOptions
from pagequarry.sources.sitemap import MAX_URLS, sitemap_urls


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagequarry", description="Fetch web pages and rank them for a query.")
    commands = parser.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    for flag, kind, default in (("top-k", int, None), ("semantic-weight", float, 0.5), ("timeout", float, 10), ("connections", int, 20), ("retries", int, 3), ("rate-limit", float, None), ("min-text", int, 0), ("out", str, None)):
        common.add_argument(f"--{flag}", type=kind, default=default, **({"dest": "top_k"} if flag == "top-k" else {}))
    common.add_argument("-k", dest="top_k", type=int)
    common.add_argument("--mode", choices=("keyword", "semantic", "both"), default="both")
    common.add_argument("--proxy", dest="proxies", action="append")
    common.add_argument("--robots", action="store_true")
    common.add_argument("--cache", action="store_true", help="keep fetched pages for later crawls")
    common.add_argument("--cache-path", default="pagequarry-cache", help="folder of kept pages; on a cluster one that all executors reach")
    common.add_argument("--cache-ttl", type=float, default=DISK_TTL, help="seconds; 0 keeps for ever")
    common.add_argument("--fmt", choices=sinks.FORMATS, default="json")
    common.add_argument("--no-progress", action="store_true")
    for name in ("crawl", "deep", "js"):
        c = commands.add_parser(name, parents=[common])
        c.add_argument("urls", nargs="+")
        c.add_argument("-q", "--query", required=True)
        if name == "deep":
            for flag, default in (("depth", 2), ("max-pages", 100), ("max-per-domain", 50), ("max-pagination", 5)):
                c.add_argument(f"--{flag}", type=int, default=default)
            c.add_argument("--similarity", type=float, default=0.85)
            c.add_argument("--follow-external", action="store_true")
            c.add_argument("--no-paginate", action="store_true")
            c.add_argument("--use-mmap", action="store_true", help="accepted; Spark's own storage levels serve")
            c.add_argument("--domain-rps", action="append", metavar="DOMAIN:RPS")
        if name == "js":
            c.add_argument("--wait", default="networkidle")
            c.add_argument("--wait-for")
            c.add_argument("--extra-wait", type=int, default=0)
            c.add_argument("--max-concurrent", type=int, default=3)
            c.add_argument("--no-block", action="store_true")
    c = commands.add_parser("search", parents=[common])
    c.add_argument("query")
    c.add_argument("-n", "--max-results", type=int, default=10)
    c.add_argument("--news", action="store_true")
    c.add_argument("--timelimit", choices=("d", "w", "m", "y"))
    c.add_argument("--region", default="wt-wt")
    c = commands.add_parser("sitemap")
    c.add_argument("url")
    c.add_argument("-n", "--max-urls", type=int, default=MAX_URLS)
    c.add_argument("--timeout", type=float, default=10)
    c.add_argument("--out")
    return parser


def _domain_rates(entries: list[str] | None) -> dict[str, float]:
    out = {}
    for e in entries or []:
        domain, colon, rate = e.rpartition(":")
        if not colon:
            raise ValueError(f"--domain-rps wants DOMAIN:RPS, not {e!r}")
        out[domain.strip()] = float(rate)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None, renderer=None, **injected) -> int:
    """Exit code 0, 1 for wrong input, 130 when interrupted. ``injected`` holds ``get`` in tests."""
    args = _parser().parse_args(argv)
    say = lambda x: print(x, file=sys.stderr)
    try:
        if args.command == "sitemap":
            found = "\n".join(sitemap_urls(args.url, args.max_urls, args.timeout, **injected))
            if args.out:
                with open(args.out, "w", encoding="utf-8") as f:
                    f.write(found + "\n")
            else:
                print(found)
            return 0
        fmt = sinks.BY_EXTENSION.get(args.out.rpartition(".")[2].lower(), args.fmt) if args.out else args.fmt
        if not args.out and fmt in ("sqlite", "parquet"):
            raise ValueError(f"{fmt} needs --out")
        spark = spark or SparkSession.builder.appName("pagequarry").getOrCreate()
        options = FetchOptions(timeout=args.timeout, retries=args.retries, connections=args.connections, rate_limit=args.rate_limit, proxies=args.proxies, respect_robots=args.robots)
        reuse = {"cache": PageCache(spark, args.cache_path, args.cache_ttl)} if args.cache else {}
        shared = {"top_k": args.top_k, "mode": args.mode, "semantic_weight": args.semantic_weight}
        if args.command == "crawl":
            rows = api.crawl(spark, args.urls, args.query, options=options, min_text_length=args.min_text, **shared, **reuse, **injected)
        elif args.command == "deep":
            options.domain_rate_limits = _domain_rates(args.domain_rps)
            limits = CrawlLimits(args.depth, args.max_pages, args.max_per_domain, args.follow_external, not args.no_paginate, args.max_pagination, args.min_text, args.similarity)
            rows = api.deep_search(spark, args.urls, args.query, limits, options=options, progress=None if args.no_progress else Progress(), **shared, **reuse, **injected)
        elif args.command == "js":
            settings = {"wait_until": args.wait, "wait_for_selector": args.wait_for, "extra_wait_ms": args.extra_wait, "block_resources": not args.no_block, "proxy": (args.proxies or [None])[0]}
            rows = api.js_crawl(spark, args.urls, args.query, min_text_length=args.min_text, renderer=renderer, max_concurrent=args.max_concurrent, **settings, **shared)
        else:
            rows = api.search_and_crawl(spark, args.query, provider, args.max_results, args.news, args.region, timelimit=args.timelimit, options=options, min_text_length=args.min_text, **shared, **reuse, **injected)
        if args.out:
            sinks.save(rows, args.out, fmt)
            say(f"saved to {args.out}")
        else:
            print(sinks.render(rows, fmt))
    except (ValueError, ImportError) as e:
        say(f"error: {e}")
        return 1
    except KeyboardInterrupt:
        say("interrupted")
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
