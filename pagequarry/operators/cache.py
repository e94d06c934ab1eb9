"""Page caches as tables (key, page, ts): freshness, least-recently-used eviction, two tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from pagequarry.functions.urls import cache_key
from pagequarry.schemas import RAW_PAGE, StringType

MEMORY_ENTRIES, MEMORY_TTL, DISK_TTL = 512, 3600, 86400


def is_fresh(ts: Column, now: Column, ttl: float) -> Column:
    """Not older than ttl seconds; a ttl of 0 never expires."""
    return F.lit(True) if not ttl else (now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) <= ttl


def latest(entries: DataFrame) -> DataFrame:
    """The last write of each key."""
    return entries.groupBy("key").agg(F.max_by("page", "ts").alias("page"), F.max("ts").alias("ts"))


def get(urls: DataFrame, entries: DataFrame, now: Column, ttl: float) -> DataFrame:
    """The urls with their page, or null for a miss."""
    last = latest(entries).select(F.col("key").alias("__k"), "page", F.col("ts").alias("__ts"))
    found = urls.join(last, cache_key(F.col("url")) == F.col("__k"), "left")
    return found.withColumn("page", F.when(is_fresh(F.col("__ts"), now, ttl), F.col("page"))).drop("__k", "__ts")


def put(entries: DataFrame, pages: DataFrame, now: Column) -> DataFrame:
    """Entries after writing (url, page)."""
    new = pages.select(cache_key(F.col("url")).alias("key"), "page", now.cast("timestamp").alias("ts"))
    return latest(entries.unionByName(new))


def invalidate(entries: DataFrame, urls: DataFrame) -> DataFrame:
    gone = urls.select(cache_key(F.col("url")).alias("key"))
    return entries.join(gone, "key", "left_anti")


def evict(accesses: DataFrame, entries: int = MEMORY_ENTRIES) -> DataFrame:
    """(key, last) of the keys that an LRU cache of so many entries still holds after the accesses (key, ts).

    Reads refresh a key like writes; a key's age for its ttl isn't touched by this.
    """
    return accesses.groupBy("key").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "key").limit(entries)


def tiered_get(urls: DataFrame, memory: DataFrame, disk: DataFrame, now: Column, memory_ttl: float = MEMORY_TTL, disk_ttl: float = DISK_TTL) -> DataFrame:
    """(url, page, tier): tier 1, else 2, else null; tier-2 hits are what to promote."""
    first = get(urls, memory, now, memory_ttl).withColumnRenamed("page", "__m")
    both = get(first, disk, now, disk_ttl)
    tier = F.when(F.col("__m").isNotNull(), 1).when(F.col("page").isNotNull(), 2)
    return both.withColumn("tier", tier).withColumn("page", F.coalesce("__m", "page")).drop("__m")


def accesses_in_order(accesses: DataFrame, ttl: float) -> DataFrame:
    """Each access (key, ts) marked as hit if its key was accessed at most ttl seconds before."""
    before = F.lag("ts").over(Window.partitionBy("key").orderBy("ts"))
    return accesses.withColumn("hit", before.isNotNull() & is_fresh(before, F.col("ts"), ttl))


class PageCache:
    """Fetched pages in a Parquet folder that crawls share: lookups by key join, stores append.

    ``path`` should be a folder that all executors reach. The last fresh entry of a key counts; a
    ``ttl`` of 0 never expires. Pages with an error or without a body aren't stored.
    """

    _SCHEMA = StructType([StructField("key", StringType()), StructField("ts", TimestampType()), *(f for f in RAW_PAGE.fields if f.name != "ord")])

    def __init__(self, spark: SparkSession, path: str, ttl: float = DISK_TTL) -> None:
        self.spark, self.path, self.ttl = spark, path, ttl

    def _there(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def entries(self) -> DataFrame:
        """(key, page, ts): the last write of each key, page being a struct."""
        if not self._there():
            return latest(self.spark.createDataFrame([], self._SCHEMA).select("key", F.struct(*self._SCHEMA.names[2:]).alias("page"), "ts"))
        return latest(self.spark.read.schema(self._SCHEMA).parquet(self.path).select("key", F.struct(*self._SCHEMA.names[2:]).alias("page"), "ts"))

    def lookup(self, urls: DataFrame) -> DataFrame:
        """Raw pages of the (ord, url) that have a fresh entry."""
        if not self._there():
            return self.spark.createDataFrame([], RAW_PAGE)
        found = get(urls.select("ord", "url"), self.entries(), F.current_timestamp(), self.ttl).where("page is not null")
        return found.select("ord", "page.*").select(*RAW_PAGE.names)

    def store(self, pages: DataFrame) -> None:
        good = pages.where((F.coalesce("error", F.lit("")) == "") & F.col("html").isNotNull())
        rows = good.select(cache_key(F.col("original_url")).alias("key"), F.current_timestamp().alias("ts"), *self._SCHEMA.names[2:])
        rows.write.mode("append").parquet(self.path)

    def clear(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
