"""robots.txt rules: in a fetching task, and as joins over a table of bodies."""

from __future__ import annotations

import time
from urllib.parse import urlparse
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from pagequarry.functions.urls import authority
from pagequarry.sources.fetch import AGENT, FetchError, Transport

TTL = 3600
_VERDICT = StructType([StructField("allowed", BooleanType()), StructField("crawl_delay", DoubleType())])


def rules(body: str | None) -> RobotFileParser:
    """Parsed rules; no body allows everything."""
    p = RobotFileParser()
    p.parse((body or "").splitlines())
    return p


class RobotsRules:
    """Rules by host, fetched once an hour; any failure allows everything."""

    def __init__(self, get: Transport, agent: str = AGENT, ttl: float = TTL, clock=time.monotonic) -> None:
        self.get, self.agent, self.ttl, self.clock = get, agent, ttl, clock
        self.known: dict[str, tuple[RobotFileParser, float]] = {}

    def allowed(self, url: str) -> bool:
        parts = urlparse(url)
        host = parts.netloc.lower()
        have = self.known.get(host)
        if have is None or self.clock() - have[1] >= self.ttl:
            try:
                r = self.get(f"{parts.scheme}://{host}/robots.txt", timeout=5)
                body = r.text if r.status == 200 else None
            except FetchError:
                body = None
            have = self.known[host] = rules(body), self.clock()
        return have[0].can_fetch(self.agent, url)

    def delay(self, url: str) -> float:
        have = self.known.get(urlparse(url).netloc.lower())
        return float(have[0].crawl_delay(self.agent) or 0.0) if have else 0.0

    def clear(self) -> None:
        self.known.clear()


def with_rules(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """Urls with allowed and crawl_delay, by the robots table (domain, body); hosts without a row allow all."""

    @F.arrow_udf(_VERDICT)
    def check(url: pa.Array, body: pa.Array) -> pa.Array:
        parsed: dict[str | None, RobotFileParser] = {}
        out = []
        for u, b in zip(url.to_pylist(), body.to_pylist()):
            p = parsed.get(b) or parsed.setdefault(b, rules(b))
            out.append({"allowed": p.can_fetch(agent, u or ""), "crawl_delay": float(p.crawl_delay(agent) or 0.0)})
        return pa.array(out, pa.struct([("allowed", pa.bool_()), ("crawl_delay", pa.float64())]))

    table = robots.select(F.lower("domain").alias("__d"), F.col("body").alias("__b"))
    rows = urls.join(table, authority(F.col("url")) == F.col("__d"), "left")
    return rows.withColumn("__r", check("url", "__b")).select(*urls.columns, "__r.allowed", "__r.crawl_delay")
