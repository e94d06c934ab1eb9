"""Fetching pages on executors: retries, content types, robots, cache, proxies and pacing.

All I/O goes through a transport, ``get(url, headers, timeout, proxy, verify) -> Response``,
so tests and other clients can take the network's place. Where rates or robots rules are
asked for, URLs are spread by host, which keeps a host's pacing and rules in one task.
"""

from __future__ import annotations

import json
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from gzip import decompress
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagequarry.functions.urls import authority
from pagequarry.operators.pacing import RETRY_STATUSES
from pagequarry.schemas import RAW_PAGE
from pagequarry.staging import staged

AGENT = "pagequarry/1.0"
HEADERS = {"User-Agent": AGENT, "Accept": "text/html,application/xhtml+xml;q=0.9,*/*;q=0.5", "Accept-Language": "en;q=0.8,*;q=0.5", "Accept-Encoding": "gzip"}
_APPLICATION = "font-woff octet-stream pdf x-bzip2 x-gzip x-tar zip"
_OTHER = "audio/mpeg audio/ogg font/woff font/woff2 image/gif image/jpeg image/png image/svg+xml image/webp video/mp4 video/webm"
BINARY_TYPES = (*(f"application/{t}" for t in _APPLICATION.split()), *_OTHER.split())


@dataclass
class Response:
    status: int
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""

    @property
    def text(self) -> str:
        _, _, charset = self.headers.get("content-type", "").partition("charset=")
        try:
            return self.body.decode(charset.split(";")[0].strip(" \"'") or "utf-8", "replace")
        except LookupError:
            return self.body.decode("utf-8", "replace")


class FetchError(Exception):
    """A request that failed; ``final`` if trying again can't help."""

    def __init__(self, message: str, final: bool = False) -> None:
        super().__init__(message)
        self.final = final


Transport = Callable[..., Response]


def http_get(url: str, headers: dict[str, str] | None = None, timeout: float = 10, proxy: str | None = None, verify: bool = True) -> Response:
    """The standard library's client; certificates are verified unless asked otherwise."""
    context = ssl.create_default_context()
    if not verify:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    handlers: list = [urllib.request.HTTPSHandler(context=context)]
    if proxy:
        handlers.append(urllib.request.ProxyHandler({"http": proxy, "https": proxy}))
    try:
        request = urllib.request.Request(url, headers=headers or HEADERS)
        try:
            r = urllib.request.build_opener(*handlers).open(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            if "redirect" in str(e.reason).lower():
                raise FetchError("too many redirects", final=True) from e
            r = e
        body = r.read()
    except TimeoutError as e:
        raise FetchError(f"no answer within {timeout} s") from e
    except urllib.error.URLError as e:
        raise FetchError(f"no answer within {timeout} s" if isinstance(e.reason, TimeoutError) else str(e.reason)) from e
    except ValueError as e:
        raise FetchError(f"not a url: {url}", final=True) from e
    except OSError as e:
        raise FetchError(str(e)) from e
    found = {k.lower(): v for k, v in r.headers.items()}
    if found.get("content-encoding") == "gzip":
        try:
            body = decompress(body)
        except OSError:
            pass
    return Response(r.status, r.url or url, found, body)


@dataclass
class FetchOptions:
    timeout: float = 10
    retries: int = 3
    backoff: float = 1.5
    connections: int = 20
    rate_limit: float | None = None
    domain_rate_limits: dict[str, float] | None = None
    proxies: list[str] | None = None
    respect_robots: bool = False
    verify: bool = True


def is_binary(content_type: str) -> bool:
    return content_type.split(";")[0].strip().lower() in BINARY_TYPES


def content_type_error(content_type):
    """Column: the error of a media or binary type, else null."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return F.when(kind.isin(*BINARY_TYPES), F.concat(F.lit("skipped content-type: "), kind))


def validate_urls(urls: list[str]) -> None:
    for u in urls:
        if urlparse(u).scheme not in ("http", "https"):
            raise ValueError(f"only http and https urls can be fetched, not {u!r}")


def fetch_one(url: str, options: FetchOptions, get: Transport = http_get, proxy: str | None = None, sleep: Callable[[float], None] = time.sleep, robots=None) -> dict:
    """One raw page. The last attempt's answer counts whatever its status."""
    page = {"url": url, "original_url": url, "status": None, "html": None, "headers": {}, "error": None}
    if robots is not None:
        if not robots.allowed(url):
            return page | {"error": "blocked by robots.txt"}
        if delay := robots.delay(url):
            sleep(delay)
    error = None
    for attempt in range(1, options.retries + 1):
        try:
            r = get(url, headers=HEADERS, timeout=options.timeout, proxy=proxy, verify=options.verify)
            if attempt == options.retries or r.status not in RETRY_STATUSES:
                headers = {k.lower(): v for k, v in r.headers.items()}
                kind = headers.get("content-type", "")
                if is_binary(kind):
                    return page | {"status": r.status, "headers": headers, "error": f"skipped content-type: {kind.split(';')[0].strip().lower()}"}
                return page | {"url": r.url, "status": r.status, "html": r.text, "headers": headers}
        except FetchError as e:
            error = str(e)
            if e.final:
                break
        if attempt < options.retries:
            sleep(options.backoff**attempt)
    return page | {"error": error or "not fetched"}


class Pacer:
    """Least spacing between requests to an authority."""

    def __init__(self, default: float | None = None, by_domain: dict[str, float] | None = None, clock=time.monotonic, sleep=time.sleep) -> None:
        self.default, self.by_domain, self.clock, self.sleep = default, dict(by_domain or {}), clock, sleep
        self.last: dict[str, float] = {}

    def wait(self, url: str) -> None:
        domain = urlparse(url).netloc.lower()
        rate = self.by_domain.get(domain, self.default)
        if not rate:
            return
        left = self.last.get(domain, float("-inf")) + 1 / rate - self.clock()
        if left > 0:
            self.sleep(left)
        self.last[domain] = self.clock()

    def set_rate(self, domain: str, rate: float) -> None:
        self.by_domain[domain] = rate

    def reset(self, domain: str | None = None) -> None:
        if domain:
            self.last.pop(domain, None)
        else:
            self.last.clear()


def fetch_pages(urls: DataFrame, options: FetchOptions | None = None, get: Transport = http_get, cached: DataFrame | None = None, cache=None) -> DataFrame:
    """Raw pages of (ord, url), with the same ord.

    ``cached`` (ord and raw page) is used instead of the network; so is a fresh page of ``cache``
    (a PageCache), which gets what had to be fetched. ``options.connections`` requests are under
    way at once: as many tasks as there are slots, and threads within a task for the rest. Hosts
    stay together in a task only where a rate or their robots.txt counts for them.
    """
    options = options or FetchOptions()
    if cached is not None:
        misses = urls.join(cached.select("ord"), "ord", "left_anti")
        return cached.select(*RAW_PAGE.names).unionByName(fetch_pages(misses, options, get, cache=cache))
    if cache is not None:
        hits = staged(cache.lookup(urls), "cached")
        new = staged(fetch_pages(urls.join(hits.select("ord"), "ord", "left_anti"), options, get), "fetched")
        cache.store(new)
        return hits.unionByName(new)
    tasks = max(1, min(options.connections, urls.sparkSession.sparkContext.defaultParallelism))
    threads = -(-options.connections // tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pagequarry.sources.robots import RobotsRules

        pacer = Pacer(options.rate_limit, options.domain_rate_limits)
        robots = RobotsRules(get) if options.respect_robots else None

        def one(ord_: int, url: str) -> tuple:
            proxy = options.proxies[int(ord_) % len(options.proxies)] if options.proxies else None
            pacer.wait(url)
            return (ord_, *fetch_one(url, options, get, proxy, robots=robots).values())

        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                lines: dict[object, list[tuple[int, str]]] = {}
                for ord_, url in zip(frame.ord, frame.url):  # what a rate or robots.txt holds for goes one by one
                    host = urlparse(url).netloc.lower()
                    lines.setdefault(host if robots or pacer.by_domain.get(host, pacer.default) else (ord_, url), []).append((ord_, url))
                done = pool.map(lambda line: [one(*x) for x in line], lines.values())
                yield pd.DataFrame([r for rows in done for r in rows], columns=RAW_PAGE.names).astype({"status": "Int32"})

    by_host = options.rate_limit or options.domain_rate_limits or options.respect_robots
    dealt = urls.select("ord", "url").repartition(tasks, *([authority(F.col("url"))] if by_host else []))
    return dealt.mapInPandas(run, RAW_PAGE)


def fetch(spark: SparkSession, urls: list[str], options: FetchOptions | None = None, get: Transport = http_get, cache=None) -> DataFrame:
    """Raw pages of a list of urls; ord is the position."""
    validate_urls(urls)
    return fetch_pages(spark.createDataFrame(list(enumerate(urls)), "ord long, url string"), options, get, cache=cache)


@dataclass
class _Host(InputPartition):
    urls: list[tuple[int, str]]


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = json.loads(options["urls"])
        validate_urls(self.urls)
        known = asdict(FetchOptions())
        self.options = FetchOptions(**{k: json.loads(options[k.lower()]) for k in known if k.lower() in options})

    def partitions(self) -> list[_Host]:
        hosts: dict[str, list[tuple[int, str]]] = {}
        for i, u in enumerate(self.urls):
            hosts.setdefault(urlparse(u).netloc.lower(), []).append((i, u))
        return [_Host(x) for x in hosts.values()]

    def read(self, partition: _Host) -> Iterator[tuple]:
        pacer = Pacer(self.options.rate_limit, self.options.domain_rate_limits)
        for i, url in partition.urls:
            pacer.wait(url)
            yield (i, *fetch_one(url, self.options).values())


class HttpPages(DataSource):
    """``spark.read.format("http_pages").option("urls", json_list)``; other options are FetchOptions as JSON."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> StructType:
        return RAW_PAGE

    def reader(self, schema: StructType) -> _HttpReader:
        return _HttpReader(self.options)
