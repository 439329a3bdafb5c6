"""Queries over the access log: cache outcomes, scores, evictions, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cache
from tessera.plans.registry import query
from tessera.sources import facts
from tessera.plans.tables import shared_dir
from tessera.streaming import keyed_cache, state

NOW = 1_706_745_600_000
TTL = 31 * 24 * 3600 * 1000
_ENTRIES = f"select user_id key, count(*) accesses, max(epoch_ms(ts)) last_ms, (sum(event_id) % 997)::bigint size, round((user_id % 11) / 10.0, 6)::double relevance from events group by user_id"
_SCORED = f"select *, greatest(0.0, 1 - ({NOW} - last_ms) / {TTL}::double) recency, 0.4 * relevance + 0.3 * greatest(0.0, 1 - ({NOW} - last_ms) / {TTL}::double) + 0.3 * ln(accesses + 1) / 10 score from ({_ENTRIES})"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.table(spark, sf_dir, "events")
    a = e.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("accesses"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"), (F.sum("event_id") % 997).alias("size"))
    return a.withColumn("relevance", F.round((F.col("key") % 11) / 10, 6))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.scored(_entries(spark, sf_dir), NOW, TTL)


@query(f"select key, accesses, size, round(recency, 6) recency, round(score, 6) score from ({_SCORED})")
def cache_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("key", "accesses", "size", F.round("recency", 6).alias("recency"), F.round("score", 6).alias("score"))


@query("""with a as (select user_id, event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 3600000000, false) hit from events) select event_type, count(*) filter (hit) hits, count(*) filter (not hit) misses, round(avg(hit::int), 6) hit_rate from a group by 1""")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = cache.hit_rates(cache.access_outcomes(facts.table(spark, sf_dir, "events"), "user_id", "ts", 3600), "event_type")
    return h.withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"with s as ({_SCORED}), b as (select *, coalesce(sum(size) over (order by score, key rows between unbounded preceding and 1 preceding), 0) before from s) select key, size from b where before < 5000")
def evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.evict_until(_scored(spark, sf_dir), 5000).select("key", "size")


@query(f"with s as ({_SCORED}), b as (select *, coalesce(sum(size) over (order by score, key rows between unbounded preceding and 1 preceding), 0) before from s) select key, size from b where before < 5000")
def state_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evictions, chosen on the state of a stream of the events: a keyed cache whose entries are read by the state data source."""
    path, checkpoint = f"{sf_dir}/events.parque[t]", f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"  # a pattern: one file or a folder
    log = spark.readStream.schema(facts.table(spark, sf_dir, "events").schema).parquet(path)
    more = "spark.sql.streaming.noDataMicroBatches.enabled"
    kept = spark.conf.get(more)
    spark.conf.set(more, "false")
    try:
        made = keyed_cache.keyed_cache(log, "user_id", "ts", 100 * 365 * 24 * 3600 * 1000, size="event_id")
        made.writeStream.format("noop").option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(more, kept)
    held = keyed_cache.entries(spark, checkpoint).withColumns({"size": F.col("size") % 997, "relevance": F.round((F.col("key") % 11) / 10, 6)})
    return cache.evict_until(cache.scored(held, NOW, TTL), 5000).select("key", "size")


@query(f"with s as ({_SCORED}), r as (select key, row_number() over (order by score, key) k, count(*) over () n from s) select key from r where k <= floor(0.2 * n)")
def bottom_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.bottom_share(_scored(spark, sf_dir)).select("key")


@query(f"select key, round(relevance * (1 - least(({NOW} - last_ms) / 86400000.0, 1.0)), 6)::double worth from ({_ENTRIES}) order by relevance * (1 - least(({NOW} - last_ms) / 86400000.0, 1.0)) desc, key limit 5")
def best_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.best_context(_entries(spark, sf_dir), NOW, 5).select("key", F.round("worth", 6).alias("worth"))


@query("""with a as (select user_id, ts, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 3600000000, false)::int hit from events), l as (select user_id, list({'h': hit::double, 'm': 1.0 - hit} order by ts, event_id) x from a group by 1),
r as (select user_id, list_reduce(x, lambda s, o: {'h': case when o.h = 1 then (s.h * (s.h + s.m) + 1) / (s.h + s.m + 1) else s.h end, 'm': case when o.h = 1 then s.m else (s.m * (s.h + s.m) + 1) / (s.h + s.m + 1) end}, {'h': 0.0::double, 'm': 0.0::double}) f from l)
select user_id, round(f.h, 6) hit_rate, round(f.m, 6) miss_rate from r""")
def rate_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cache.access_outcomes(facts.table(spark, sf_dir, "events"), "user_id", "ts", 3600)
    r = cache.rate_recurrence(o, "user_id", "ts")
    return r.select("user_id", F.round("hit_rate", 6).alias("hit_rate"), F.round("miss_rate", 6).alias("miss_rate"))


@query(f"""with e as ({_ENTRIES}), m as (select avg(accesses) a from e), x as (select key, unnest([case when {NOW} - last_ms > 86400000 then 'lru' end, case when accesses < 0.1 * a then 'lfu' end, case when {NOW} - last_ms > 2 * 86400000 then 'ttl' end, case when relevance < 0.15 then 'fifo' end]) policy from e, m) select key, policy from x where policy is not null""")
def eviction_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    out = None
    for policy in ("lru", "lfu", "ttl", "fifo"):
        gone = cache.evictions_by_policy(e, policy, NOW, 24 * 3600 * 1000, 0.3).select("key", F.lit(policy).alias("policy"))
        out = gone if out is None else out.union(gone)
    return out


@query(f"select key from ({_ENTRIES}) where relevance >= 0.5 and size <= 800")
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.admitted(_entries(spark, sf_dir).withColumnRenamed("size", "tokens"), 0.5, 800).select("key")


@query("select time_bucket(interval '1 day', ts) window_start, event_type, count(*) n from events group by all")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.windowed_counts(facts.table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "1 hour")


@query("""with s as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval '6 hours' then 0 else 1 end new from events), g as (select *, sum(new) over (partition by user_id order by ts) g from s)
select user_id, min(ts) session_start, max(ts) + interval '6 hours' session_end, count(*) n from g group by user_id, g""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sessions(facts.table(spark, sf_dir, "events"), "ts", "user_id", "6 hours", "1 hour")
