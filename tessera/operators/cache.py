"""Keyed cache operators over an access log or a snapshot of entries: scores, rankings, evictions, hit rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def access_outcomes(log: DataFrame, key: str, ts: str, ttl_s: int) -> DataFrame:
    """log with hit: whether the key's previous access is at most ttl_s seconds old (an access renews the entry)."""
    w = Window.partitionBy(key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return log.withColumn("hit", F.coalesce(us - F.lag(us).over(w) <= ttl_s * 1_000_000, F.lit(False)))


def hit_rates(outcomes: DataFrame, by: str) -> DataFrame:
    """by, hits, misses and hit_rate from counts."""
    hits = F.sum(F.col("hit").cast("long"))
    return outcomes.groupBy(by).agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), (hits / F.count("*")).alias("hit_rate"))


def rate_recurrence(outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """key, hit_rate and miss_rate: with total = hit_rate + miss_rate, a hit makes hit_rate (hit_rate total + 1) / (total + 1), a miss miss_rate likewise.

    Each access needs the rates before it, so a key's accesses stream through one task in order, batch by batch; a task
    holds one batch and two numbers, however many accesses a key has.
    """
    kind = outcomes.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, m, started = None, 0.0, 0.0, False
        for t in frames:
            done = []
            for k, hit in t.itertuples(index=False):
                if not started or k != now:
                    if started:
                        done.append((now, h, m))
                    now, h, m, started = k, 0.0, 0.0, True
                total = h + m
                if hit:
                    h = (h * total + 1) / (total + 1)
                else:
                    m = (m * total + 1) / (total + 1)
            yield pd.DataFrame(done, columns=[key, "hit_rate", "miss_rate"])
        if started:
            yield pd.DataFrame([(now, h, m)], columns=[key, "hit_rate", "miss_rate"])

    ordered = outcomes.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, order)
    return ordered.select(key, "hit").mapInPandas(run, f"`{key}` {kind}, hit_rate double, miss_rate double")


def evictions_by_policy(entries: DataFrame, policy: str, now_ms: int, ttl_ms: int, threshold: float = 0.3) -> DataFrame:
    """Entries (key, relevance, last_ms, accesses) that the policy lets go; the mean of the accesses is one aggregation."""
    mean = F.broadcast(entries.agg(F.avg("accesses").alias("_mean")))
    return entries.join(mean).where(S.evictable(policy, F.lit(now_ms) - F.col("last_ms"), F.col("accesses"), F.col("_mean"), F.col("relevance"), ttl_ms, threshold)).drop("_mean")


def scored(entries: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """entries (key, relevance, last_ms, accesses, size) with recency and score."""
    rec = S.recency(F.lit(now_ms) - F.col("last_ms"), F.lit(ttl_ms))
    return entries.withColumn("recency", rec).withColumn("score", S.cache_score("relevance", "recency", "accesses"))


def evict_until(scored_: DataFrame, target: int, group: str | None = None) -> DataFrame:
    """Entries that go, lowest score first, until the sizes freed reach the target (the one that reaches it goes too).

    Without a group the running sum is taken in two steps, over ranges of the score and inside the range that reaches the
    target, so no task holds the whole cache.
    """
    if group:
        w = Window.partitionBy(group).orderBy("score", "key").rowsBetween(Window.unboundedPreceding, -1)
        return scored_.withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0))).where(F.col("_before") < target).drop("_before")
    binned = scored_.withColumn("_b", F.floor(F.col("score") * 256).cast("int"))
    sums = binned.groupBy("_b").agg(F.sum("size").alias("_s"))
    before = sums.withColumn("_start", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_start") < target).select("_b", "_start")
    w = Window.partitionBy("_b").orderBy("score", "key").rowsBetween(Window.unboundedPreceding, -1)
    j = binned.join(F.broadcast(before), "_b").withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    return j.where(F.col("_before") < target).drop("_b", "_start", "_before")


def bottom_share(scored_: DataFrame, share: float = 0.2, capacity: int | None = None, full: float = 0.8, parity: bool = False) -> DataFrame:
    """The floor(share * n) lowest entries; none while the sizes stay within ``full`` of the capacity, if one is given.

    Entries are counted by ranges of the score and ranked only inside the range where the cut lies. Under ``parity`` all
    entries go where the floor is 0.
    """
    n, used = scored_.agg(F.count("*"), F.sum("size") if "size" in scored_.columns else F.lit(0)).first()
    if capacity is not None and (used or 0) <= full * capacity:
        return scored_.limit(0)
    k = int(share * n)
    if parity and k == 0:
        return scored_
    binned = scored_.withColumn("_b", F.floor(F.col("score") * 4096).cast("int"))
    sums = binned.groupBy("_b").count().withColumn("_start", F.sum("count").over(Window.orderBy("_b")) - F.col("count"))
    w = Window.partitionBy("_b").orderBy("score", "key")
    whole = binned.join(F.broadcast(sums.where(F.col("_start") + F.col("count") <= k).select("_b")), "_b", "left_semi")
    cut = binned.join(F.broadcast(sums.where((F.col("_start") < k) & (F.col("_start") + F.col("count") > k)).select("_b", "_start")), "_b")
    part = cut.where(F.lit(k) > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_start") + F.col("_r") <= k)
    return whole.select(*scored_.columns).union(part.select(*scored_.columns))


def best_context(entries: DataFrame, now_ms: int, limit: int = 1) -> DataFrame:
    """Entries by relevance * (1 - age weight), best first."""
    return entries.withColumn("worth", F.col("relevance") * (1 - S.age_weight(F.lit(now_ms) - F.col("last_ms")))).orderBy(F.desc("worth"), "key").limit(limit)


def admitted(entries: DataFrame, threshold: float, max_tokens: int) -> DataFrame:
    return entries.where((F.col("relevance") >= threshold) & (F.col("tokens") <= max_tokens))
