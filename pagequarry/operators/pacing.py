"""Request spacing by domain, retry schedules, proxies and progress, as plans over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.urls import authority

RETRY_STATUSES = (429, 500, 502, 503, 504)


def interval(domain: Column, default_rps: float | None, domain_rps: dict[str, float] | None = None) -> Column:
    """Seconds between a domain's requests; 0 where the rate is missing or 0."""
    rps = F.lit(default_rps or 0.0)
    for d, r in (domain_rps or {}).items():
        rps = F.when(domain == d, float(r or 0.0)).otherwise(rps)
    return F.when(rps > 0, 1.0 / rps).otherwise(0.0)


def schedule(arrivals: DataFrame, default_rps: float | None, domain_rps: dict[str, float] | None = None, order: str = "ord") -> DataFrame:
    """Arrivals (url, at in seconds) with the time each may start: at, but an interval after its domain's last.

    start_i = max over j <= i of at_j + (i - j) * interval, a running maximum of at_j - j * interval.
    """
    rows = arrivals.withColumn("domain", authority(F.col("url"))).withColumn("__gap", interval(F.col("domain"), default_rps, domain_rps))
    w = Window.partitionBy("domain").orderBy("at", order)
    rows = rows.withColumn("__i", F.row_number().over(w))
    lead = F.max(F.col("at") - F.col("__i") * F.col("__gap")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", lead + F.col("__i") * F.col("__gap")).drop("__i", "__gap")


def sequential_schedule(durations: DataFrame, rate: float, order: str = "ord", lanes: list[str] | None = None) -> DataFrame:
    """One request at a time in each lane, starts at least 1 / rate apart: the sum of max(duration, 1 / rate) before it."""
    w = Window.partitionBy(*(lanes or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return durations.withColumn("start", F.coalesce(F.sum(F.greatest(F.col("duration"), F.lit(1.0 / rate))).over(w), F.lit(0.0)))


def assign_proxy(urls: DataFrame, proxies: list[str], order: str = "ord") -> DataFrame:
    """Round robin by position."""
    return urls.withColumn("proxy", F.element_at(F.array(*map(F.lit, proxies)), (F.pmod(F.col(order), F.lit(len(proxies))) + 1).cast("int")))


def retry_plan(attempts: DataFrame, retries: int = 3, backoff: float = 1.5) -> DataFrame:
    """Attempts (status or null for a failed request, attempt from 1) with retry and its wait in seconds."""
    again = (F.col("attempt") < retries) & (F.col("status").isNull() | F.col("status").isin(*RETRY_STATUSES))
    return attempts.withColumn("retry", again).withColumn("wait", F.when(again, F.pow(F.lit(backoff), F.col("attempt"))))


def progress(events: DataFrame, total: Column, partition: list[str] | None = None, order: str = "ord") -> DataFrame:
    """Running counters of events (event, at in seconds) and the time left at the present rate."""
    w = Window.partitionBy(*(partition or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda *kinds: F.sum(F.when(F.col("event").isin(*kinds), 1).otherwise(0)).over(w)
    rows = events.withColumns({"done": is_("fetched", "cached", "skipped", "error"), "errors": is_("error"), "cached": is_("cached"), "elapsed": F.col("at") - F.min("at").over(w), "total": total})
    rate = F.col("done") / F.col("elapsed")
    return rows.withColumn("eta", F.when((F.col("done") > 0) & (F.col("total") > F.col("done")) & (F.col("elapsed") > 0), (F.col("total") - F.col("done")) / rate))
