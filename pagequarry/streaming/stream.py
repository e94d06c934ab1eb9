"""Pages as they arrive: Structured Streaming with the batch transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pagequarry.functions.html import parse_many
from pagequarry.functions.text import fingerprint, words
from pagequarry.operators.rank import Encoder, blend, check_rank_arguments, rank

CORPUS = ("page", "batch")


def read_pages(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """Raw pages from Parquet files that are added to a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def ranked_alone(pages: DataFrame, mode: str = "both", semantic_weight: float = 0.5) -> DataFrame:
    """Each page ranked in a corpus of its own: scaling one value gives 0, so every score is 0. Needs no state."""
    columns = {"keyword_score": F.lit(0.0)} if mode != "semantic" else {}
    if mode != "keyword":
        columns["semantic_score"] = F.lit(0.0)
    return blend(pages.withColumns(columns), mode, semantic_weight)


def rank_stream(pages: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, corpus: str = "page", mode: str = "both", semantic_weight: float = 0.5, encoder: Encoder | None = None, min_text_length: int = 0, order: str = "ord") -> StreamingQuery:
    """Start ranking a stream of raw pages; ``sink(rows, batch_id)`` gets each micro-batch.

    corpus "page" ranks every page by itself; "batch" ranks a micro-batch together.
    """
    check_rank_arguments(query, mode, semantic_weight)
    if corpus not in CORPUS:
        raise ValueError(f"unknown corpus {corpus!r}: one of {', '.join(CORPUS)}")

    def each(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_many(batch, min_text_length)
        rows = ranked_alone(parsed, mode, semantic_weight) if corpus == "page" else rank(parsed, query, None, mode, semantic_weight, encoder, order)
        sink(rows, batch_id)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(pages: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A stream's pages without those whose url came before; with an event time, state older than the delay is dropped."""
    if event_time:
        return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    return pages.dropDuplicates(["url"])


def first_content(pages: DataFrame, text: str = "text") -> DataFrame:
    """A stream's pages without those whose words came before in the same order; blank texts all stay apart by url."""
    joined = F.concat_ws(" ", words(F.col(text)))
    key = F.when(joined == "", F.concat(F.lit("blank:"), F.col("url"))).otherwise(fingerprint(joined))
    return pages.withColumn("__content", key).dropDuplicates(["__content"]).drop("__content")


def progress_stream(events: DataFrame) -> DataFrame:
    """Counters of a stream of events (event): a running aggregate for complete or update mode."""
    is_ = lambda *kinds: F.sum(F.when(F.col("event").isin(*kinds), 1).otherwise(0))
    return events.groupBy().agg(is_("fetched", "cached", "skipped", "error").alias("done"), is_("error").alias("errors"), is_("cached").alias("cached"))
