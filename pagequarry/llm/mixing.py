"""Mixing sources to target weights by balanced sampling with the cube method.

Each source's documents get one inclusion probability, chosen so that expected
tokens follow the target weights (tokens**temperature by default) at the largest
total that keeps every probability at most 1. The flight phase then walks each
vector of probabilities inside the null space of two constraints, the count of
documents and the count of tokens, until at most two units are left undecided.

Units are spread over buckets of a source by a hash of their id, the number of
buckets growing with the source, so that no task holds a whole large source. What
a bucket leaves undecided (two units at most) flies again in its source, in tiers
of at most ``bucket_units``, then all sources together; the few units left there
are the landing problem, which is rounded by the same walk with the token
constraint dropped, then at random.

Defined cases: rows that share a doc_id are one unit, rows without id one unit
for each text; a null source is a source of its own; null and empty texts weigh
no tokens and follow the document constraint only; a source of no tokens is kept
whole; sources without a given weight go; weights that are negative or not finite
raise ValueError; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ids_for_join, stash

TEMPERATURE = 0.5
BUCKET_UNITS = 20_000
_EPS = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the walk: 0 or 1 but for at most two units.

    Three undecided units at a time move along the vector that changes neither
    sum(p) nor sum(p * tokens): a 2 x 3 system's null space is the cross product
    of its rows.
    """
    rng = np.random.default_rng(seed)
    p = np.asarray(p, float)
    p = np.where(p <= _EPS, 0.0, np.where(p >= 1 - _EPS, 1.0, p))  # what lies this close is decided
    draws = iter(rng.random(len(p) + 8).tolist())
    live: list[int] = []
    out = p.tolist()
    w = np.asarray(tokens, float).tolist()
    for i in np.flatnonzero((p > 0) & (p < 1)).tolist():
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        wa, wb, wc = w[a], w[b], w[c]
        u, v, x = wc - wb, wa - wc, wb - wa
        if u == v == x == 0:
            u, v, x = 1.0, -1.0, 0.0
        up = down = np.inf
        for q, d in ((out[a], u), (out[b], v), (out[c], x)):
            if d > 0:
                up, down = min(up, (1 - q) / d), min(down, q / d)
            elif d < 0:
                up, down = min(up, q / -d), min(down, (1 - q) / -d)
        step = up if next(draws) < down / (up + down) else -down
        live = []
        for i2, d in ((a, u), (b, v), (c, x)):
            q = out[i2] + step * d
            out[i2] = q = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q
            if 0.0 < q < 1.0:
                live.append(i2)
        if len(live) == 3:  # rounding only
            k = min(live, key=lambda j: min(out[j], 1 - out[j]))
            out[k] = float(round(out[k]))
            live.remove(k)
    return np.array(out)


def land(p: np.ndarray, seed: int) -> np.ndarray:
    """Decide what is left: pairs move along (1, -1), the last unit is drawn."""
    rng = np.random.default_rng(seed)
    p = np.array(p, float)
    live = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    while len(live) > 1:
        a, b = live[-2:]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if rng.random() < down / (up + down) else -down
        p[a], p[b] = p[a] + step, p[b] - step
        live = live[:-2] + [i for i in (a, b) if _EPS < p[i] < 1 - _EPS]
    for i in live:
        p[i] = float(rng.random() < p[i])
    return np.round(p)


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def _unit(doc_id: Column, text: Column) -> Column:
    """A document's id, or for rows without one a digest of the text."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.concat(F.lit("t"), F.coalesce(F.sha2(text, 256), F.lit(""))))


def _fly(units: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    schema = units.select("unit", "source", "tokens", "p").schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("unit", ignore_index=True)
        seed = zlib.crc32(rows.unit.iloc[0].encode()) if len(rows) else 0
        p = flight(rows.p.to_numpy(), rows.tokens.to_numpy(), seed)
        return rows[["unit", "source", "tokens"]].assign(p=land(p, seed + 1) if last else p)

    return units.groupBy(*keys).applyInPandas(run, schema)


def targets(units: DataFrame, temperature: float, weights: dict[str, float] | None) -> DataFrame:
    """(source, p, buckets): a source's probability and its number of buckets.

    One row for each source; p is the weight's share of tokens over the source's own, scaled so that the largest is 1.
    """
    if bad := [k for k, x in (weights or {}).items() if not (math.isfinite(x) and x >= 0)]:
        raise ValueError(f"weights must be finite and not negative: {sorted(map(str, bad))}")
    by = units.groupBy("source").agg(F.count("*").alias("units"), F.sum("tokens").alias("total"))
    if weights is None:
        want = F.pow(F.col("total").cast("double"), F.lit(float(temperature)))
    else:
        want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit(""))), F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    by = by.withColumn("ratio", F.when(F.col("total") > 0, want / F.col("total")))
    top = by.agg(F.max("ratio").alias("top"))
    p = F.when(F.col("ratio").isNull(), 1.0).when(F.col("top") > 0, F.col("ratio") / F.col("top")).otherwise(0.0)
    return by.crossJoin(F.broadcast(top)).select("source", p.alias("p"), F.greatest(F.lit(1), F.ceil(F.col("units") / BUCKET_UNITS)).cast("int").alias("buckets"))


def balanced_sample(docs: DataFrame, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> DataFrame:
    """(unit, source, tokens, p) of the chosen units, p being the inclusion probability."""
    rows = docs.select(_unit(F.col("doc_id"), F.col("text")).alias("unit"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).cast("long").alias("tokens"))
    units = stash(rows.groupBy("unit").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens")), "units")
    plan = stash(targets(units, temperature, weights), "targets")
    most = (plan.agg(F.max("buckets")).first() or [1])[0] or 1
    s = plan.withColumnRenamed("source", "its")
    placed = units.join(s, F.col("source").eqNullSafe(F.col("its"))).drop("its")  # one row a source: its size decides on a broadcast
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("unit"), F.col("buckets")))
    flown = stash(_fly(placed, ["source", "bucket"]), "flown")
    done = flown.where("p >= 1")
    while most > 1:  # undecided units fly again, in ever fewer buckets
        most = -(-most * 2 // BUCKET_UNITS)
        open_ = flown.where("p > 0 and p < 1").withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(most)))
        flown = stash(_fly(open_, ["source", "bucket"]), "flown")
        done = done.unionByName(flown.where("p >= 1"))
    rest = flown.where("p > 0 and p < 1").withColumn("bucket", F.lit(0))  # at most two a source
    chosen = done.unionByName(_fly(rest, ["bucket"], last=True).where("p >= 1")).drop("p")
    return chosen.join(plan.select(F.col("source").alias("its"), "p"), F.col("source").eqNullSafe(F.col("its"))).drop("its")


def mixed_documents(docs: DataFrame, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> DataFrame:
    """The chosen documents, all columns as they are.

    The units are broadcast to the texts if their counted rows are few enough; else both are shuffled.
    """
    kept = stash(balanced_sample(docs, temperature, weights).select(F.col("unit").alias("__pq_kept")), "kept-units")
    rows = docs.withColumn("__pq_unit", _unit(F.col("doc_id"), F.col("text")))
    return rows.join(ids_for_join(kept), F.col("__pq_unit") == F.col("__pq_kept"), "left_semi").drop("__pq_unit")


def mixing_report(docs: DataFrame, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, tokens, p): the chosen units; rows without id have a null doc_id."""
    chosen = balanced_sample(docs, temperature, weights)
    return chosen.select(F.when(~F.col("unit").startswith("t"), F.col("unit")).cast("long").alias("doc_id"), "source", "tokens", "p")
