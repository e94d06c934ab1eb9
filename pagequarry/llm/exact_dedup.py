"""Exact duplicates with a heavy-hitter split.

Texts are compared by SHA-256. A Misra-Gries pass over the digests names at
most ``k`` candidates; an exact count confirms them, and the winners (digest
and kept row, at most ``k``) are broadcast so that their copies leave on the map
side. All other digests take an ordinary shuffle of (digest, doc_id); no text is
ever shuffled to find duplicates. To drop them, the copies of winners leave on
the map side again; the keys of the other copies are broadcast if their counted
rows are few enough, else the texts that are left are shuffled once.

Defined cases: rows with a null text are never duplicates; empty texts equal
each other; the copy with the least doc_id stays (null ids last); of repeated
rows (same id and text) one stays; an empty table gives an empty result; other
columns are carried untouched whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ids_for_join, stash

HEAVY_K = 1024
_LAST = 0x7FFFFFFFFFFFFFFF


def _shrink(c: Counter, k: int) -> Counter:
    if len(c) <= k:
        return c
    cut = sorted(c.values(), reverse=True)[k]
    return Counter({d: n - cut for d, n in c.items() if n > cut})


def misra_gries(rows: DataFrame, column: str, k: int = HEAVY_K) -> DataFrame:
    """(item, lower_bound): at most k items, among them each that fills over 1/(k+1) of the rows.

    Each partition is summarised by a task of its own. Entries then move by item, 64 summaries
    to a task; each merge takes a cut from over k entries at once, so all cuts together stay
    below 1/(k+1) of the rows, however the entries are spread.
    """
    schema = "item binary, n long"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            if b.num_columns == 2:
                for d, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    c[d] += n
            else:
                c.update(b.column(0).to_pylist())
            c = _shrink(c, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["item", "n"])

    parts = rows.rdd.getNumPartitions()
    out = rows.select(F.col(column).alias("item")).mapInArrow(summarise, schema)
    while parts > 1:
        parts = -(-parts // 64)
        out = out.repartition(parts, "item").mapInArrow(summarise, schema)
    return out


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _heavy(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(digest, doc_id) of each row with a text; the winners (digest, kept_id, same), at most k rows."""
    spark = docs.sparkSession
    rows = stash(docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    named = misra_gries(rows, "digest", k).where("n > 1").select(F.col("item").alias("digest"))
    named = spark.createDataFrame(named.collect(), named.schema)  # at most k rows
    counted = rows.join(F.broadcast(named), "digest").groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    winners = counted.groupBy("digest").agg(F.min_by(F.struct("doc_id", "same"), _order()).alias("w"), F.sum("same").alias("n")).where("n > 1").select("digest", F.col("w.doc_id").alias("kept_id"), F.col("w.same").alias("same"))
    return rows, spark.createDataFrame(winners.collect(), winners.schema)  # at most k rows


def _order() -> Column:
    return F.coalesce("doc_id", F.lit(_LAST))


def _light(marked: DataFrame) -> DataFrame:
    """(digest, doc_id, kept_id, times): how many rows of this digest and id go; no digest of a winner.

    One shuffle of (digest, doc_id); a group is counted and joined, never held as a list.
    """
    rest = marked.where(F.col("heavy").isNull()).select("digest", "doc_id").repartition(F.col("digest"))
    by_id = rest.groupBy("digest", "doc_id").agg(F.count("*").alias("same"))
    first = by_id.groupBy("digest").agg(F.min_by(F.struct("doc_id", "same"), _order()).alias("w"), F.sum("same").alias("n")).where("n > 1").select("digest", F.col("w.doc_id").alias("kept_id"))
    times = F.when(F.col("doc_id").eqNullSafe(F.col("kept_id")), F.col("same") - 1).otherwise(F.col("same"))
    return by_id.join(first, "digest").select("digest", "doc_id", "kept_id", times.alias("times")).where("times > 0")


def exact_duplicates(docs: DataFrame, k: int = HEAVY_K) -> DataFrame:
    """(doc_id, kept_id) for each row whose text equals that of the row kept instead of it."""
    rows, winners = _heavy(docs, k)
    marked = rows.join(F.broadcast(winners.withColumn("heavy", F.lit(True))), "digest", "left")
    heavy = marked.where(F.col("heavy") & ~F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("doc_id", "kept_id")
    # the kept row of a heavy text may itself be repeated
    again = winners.where("same > 1").select(F.col("kept_id").alias("doc_id"), "kept_id", F.explode(F.sequence(F.lit(2), F.col("same"))).alias("i")).drop("i")
    light = _light(marked).select("doc_id", "kept_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i")).drop("i")
    return heavy.unionByName(light).unionByName(again)


def drop_exact_duplicates(docs: DataFrame, k: int = HEAVY_K) -> DataFrame:
    """The documents without exact duplicates, all columns as they are."""
    rows, winners = _heavy(docs, k)
    light = stash(_light(rows.join(F.broadcast(winners.select("digest", F.lit(True).alias("heavy"))), "digest", "left")), "exact-gone")
    d, key, own = "__pq_digest", "__pq_doc", [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumns({d: digest(F.col("text")), key: F.col("doc_id").cast("long")})
    won = F.broadcast(winners.select(F.col("digest").alias("__pq_won"), F.col("kept_id").alias("__pq_kept")))
    marked = marked.join(won, marked[d] == F.col("__pq_won"), "left")
    marked = marked.where(F.col("__pq_won").isNull() | F.col(key).eqNullSafe(F.col("__pq_kept")))  # here the copies of hot texts leave, on the map side
    match = lambda r: (marked[d] == r["digest"]) & marked[key].eqNullSafe(r["doc_id"])
    others = light.where(~F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("digest", "doc_id")
    kept = marked.join(ids_for_join(others), match(others), "left_anti")
    repeated = stash(light.where(F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("digest", "doc_id").unionByName(winners.where("same > 1").select("digest", F.col("kept_id").alias("doc_id"))), "repeated-rows")
    if repeated.isEmpty():
        return kept.select(*own)
    few = ids_for_join(repeated)
    alike = (kept[d] == few["digest"]) & kept[key].eqNullSafe(few["doc_id"])
    once = kept.join(few, alike, "left_semi").dropDuplicates([d, key])
    return kept.join(few, alike, "left_anti").select(*own).unionByName(once.select(*own))


ORACLE = """
SELECT doc_id, kept_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id,
         row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS rn
  FROM documents WHERE text IS NOT NULL)
WHERE rn > 1
"""
