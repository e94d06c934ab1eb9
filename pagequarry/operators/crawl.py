"""Wave-by-wave crawl over any page source, as joins between frontier and seen tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.functions.html import parse
from pagequarry.functions.urls import authority, next_page_url, normalize, same_domain
from pagequarry.operators.dedup import SeenState, among, kept_ids
from pagequarry.schemas import PARSED
from pagequarry.staging import staged

#: (ord, url) -> raw pages with the same ord
PageSource = Callable[[DataFrame], DataFrame]


@dataclass
class CrawlLimits:
    depth: int = 2
    max_pages: int | None = 100  # None: no cap
    max_pages_per_domain: int = 50
    follow_external: bool = False
    paginate: bool = True
    max_pagination_pages: int = 5
    min_text_length: int = 0
    similarity_threshold: float = 0.85


def running_domain_counts(rows: DataFrame, prior: DataFrame | None, domain: str = "domain", order: str = "ord") -> DataFrame:
    """Each row with the number of kept pages of its domain up to and with it, earlier waves included."""
    w = Window.partitionBy(domain).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("domain_count", F.sum("kept").over(w))
    if prior is None:
        return out
    old = prior.select(F.col("domain").alias("__d"), F.col("pages").alias("__p"))
    return out.join(old, F.col(domain) == F.col("__d"), "left").withColumn("domain_count", F.col("domain_count") + F.coalesce("__p", F.lit(0))).drop("__d", "__p")


def expand(kept: DataFrame, seen: DataFrame, prior: DataFrame | None, limits: CrawlLimits) -> DataFrame:
    """The next frontier (ord, url, depth, page_num) of a wave's kept pages.

    ``kept`` has ord, requested (the url asked for), url (the final one), links, depth and page_num. A url
    enters at its first mention by (parent, position); a page's pagination follows its links.
    """
    links = kept.where(F.col("depth") < limits.depth).select("ord", "requested", (F.col("depth") + 1).alias("depth"), F.posexplode("links").alias("pos", "link"))
    links = links.withColumn("url", normalize(F.col("link")))
    if not limits.follow_external:
        links = links.where(same_domain(F.col("url"), F.col("requested")))
    links = links.withColumns({"domain": authority(F.col("url")), "kept": F.lit(0), "page_num": F.lit(1)})
    pages = kept.select("ord", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("url"), authority(F.col("requested")).alias("domain"), F.lit(0).alias("depth"), F.lit(1).alias("kept"), F.lit(1).alias("page_num"))
    counted = running_domain_counts(links.select(*pages.columns).unionByName(pages), prior)
    found = counted.where((F.col("kept") == 0) & (F.col("domain_count") < limits.max_pages_per_domain)).select("ord", "pos", "url", "depth", "page_num")
    if limits.paginate:
        more = kept.where(F.col("page_num") < limits.max_pagination_pages)
        more = more.select("ord", F.lit(2147483647).alias("pos"), normalize(next_page_url("requested", "links", "page_num")).alias("url"), "depth", (F.col("page_num") + 1).alias("page_num"))
        found = found.unionByName(more.where("url is not null"))
    # a kept page's own address counts as seen from its turn on
    own = kept.select("ord", F.lit(-1).alias("pos"), "url", "depth", F.lit(0).alias("page_num"))
    found = found.unionByName(own)
    fresh = found.join(seen.select(F.col("url").alias("__s")), F.col("url") == F.col("__s"), "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("ord", "pos"))).where("__n = 1 and page_num > 0")
    # one global order: a wave's frontier is bounded by the pages kept and their links
    return first.select(F.row_number().over(Window.orderBy("ord", "pos")).cast("long").alias("ord"), "url", "depth", "page_num")


def deep_crawl(spark: SparkSession, urls: list[str] | DataFrame, source: PageSource, limits: CrawlLimits | None = None, progress=None) -> DataFrame:
    """Kept pages in crawl order: ord, url, parsed columns, depth, page_num. ``urls``: seeds, or a table of them (ord, url) with unique ord."""
    limits = limits or CrawlLimits()
    most = math.inf if limits.max_pages is None else limits.max_pages
    seeds = urls if isinstance(urls, DataFrame) else spark.createDataFrame(list(enumerate(urls)), "ord long, url string")
    bad = seeds.where(F.coalesce(~F.lower("url").rlike("^https?:"), F.lit(True))).select("url").take(1)
    if bad:
        raise ValueError(f"not an http or https url: {bad[0].url!r}")
    frontier = staged(seeds.select(F.col("ord").cast("long").alias("ord"), normalize(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit(1).alias("page_num")), "frontier")
    state, seen, counts, results, n = SeenState(limits.similarity_threshold), frontier.select("url").distinct(), None, [], 0
    if progress:
        progress.start(frontier.count())
    while n < most and not frontier.isEmpty():
        raw = source(frontier.select("ord", "url"))
        raw = raw.where((F.coalesce("error", F.lit("")) == "") & (F.coalesce("html", F.lit("")) != "")).select("ord", "url", "html")
        wave = staged(parse(raw, limits.min_text_length).where(F.length("text") > 0), "wave")
        # what is decided from here on are ids; the pages stay in the wave's table
        texts = wave.select("ord", "text")
        if state.texts is not None:
            texts = among(texts, state.content_duplicates(wave), "left_anti", "ord")
        kept = kept_ids(texts, "ord", limits.similarity_threshold).withColumnRenamed("id", "ord")
        kept = kept if limits.max_pages is None else kept.orderBy("ord").limit(limits.max_pages - n)
        kept = staged(kept.join(frontier.withColumnRenamed("url", "requested"), "ord"), "kept")
        pages = wave.join(kept, "ord")
        state.register_texts(wave.select("ord", "text").join(kept.select("ord"), "ord", "left_semi"))
        results.append(pages.withColumn("__wave", F.lit(len(results))))
        n += kept.count()
        if progress:
            progress.fetched_many(kept.count())
        if n >= most:
            break
        frontier = staged(expand(pages, seen, counts, limits), "frontier")
        seen = staged(seen.unionByName(frontier.select("url")).unionByName(pages.select("url")).distinct(), "seen")
        here = kept.groupBy(authority(F.col("requested")).alias("domain")).agg(F.count("*").alias("pages"))
        counts = staged(here if counts is None else counts.unionByName(here).groupBy("domain").agg(F.sum("pages").alias("pages")), "domains")
        if progress:
            progress.add_queued(frontier.count())
    if progress:
        progress.done()
    columns = ["url", *PARSED.names, "depth", "page_num"]
    if not results:
        return spark.createDataFrame([], "ord long, url string").limit(0)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.row_number().over(Window.orderBy("__wave", "ord")).cast("long").alias("ord"), *columns)
