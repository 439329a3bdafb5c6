"""The keyed cache on real state: hits, tombstones, expiry by the clock, restart, and evictions that equal those of the log in batch."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import cache
from tessera.streaming import keyed_cache

SCHEMA = "k string, at timestamp, size long, gone boolean"
BASE = 1_700_000_000_000


@pytest.fixture
def stream(spark, tmp_path):
    folder, checkpoint, out, n = tmp_path / "in", str(tmp_path / "cp"), str(tmp_path / "out"), [0]
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a query with timers of the clock runs on
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def put(rows):
        n[0] += 1
        df = spark.createDataFrame([(k, BASE + s * 1000, size, gone) for k, s, size, gone in rows], "k string, ms long, size long, gone boolean")
        df.select("k", F.timestamp_millis("ms").alias("at"), "size", "gone").coalesce(1).write.mode("append").parquet(str(folder))

    def run(ttl_ms):
        log = spark.readStream.schema(SCHEMA).parquet(str(folder))
        made = keyed_cache.keyed_cache(log, "k", "at", ttl_ms, "size", "gone")
        made.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out)
        last = rows.agg(F.max("batch")).first()[0]
        return {r.k: (r.event, r.hits, r.misses) for r in rows.where(F.col("batch") == last).collect()}

    yield put, run, checkpoint
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hits_tombstones_and_restart(spark, stream):
    put, run, checkpoint = stream
    hour = 3_600_000
    put([("a", 0, 5, False), ("a", 10, 7, False), ("b", 0, 1, False), ("c", 0, 1, None), ("c", 5000, 2, None)])
    assert run(hour) == {"a": ("access", 1, 1), "b": ("access", 0, 1), "c": ("access", 0, 2)}
    put([("a", 20, 3, False), ("b", 30, 0, True), ("d", 1, 9, False)])  # another run of the query, from its checkpoint
    assert run(hour) == {"a": ("access", 2, 1), "b": ("dropped", 0, 1), "d": ("access", 0, 1)}
    held = {r.key: (r.last_ms - BASE, r.accesses, r.size) for r in keyed_cache.entries(spark, checkpoint).collect()}
    assert held == {"a": (20_000, 3, 15), "c": (5_000_000, 1, 2), "d": (1000, 1, 9)}
    put([("b", 40, 1, False), ("a", 50, 0, False), ("a", 50, 0, True)])
    assert run(hour) == {"b": ("access", 0, 2), "a": ("dropped", 3, 1)}
    assert {r.key for r in keyed_cache.entries(spark, checkpoint).collect()} == {"b", "c", "d"}


def test_entries_expire_by_the_clock(spark, stream):
    put, run, checkpoint = stream
    put([("a", 0, 1, False), ("b", 0, 1, False)])
    run(2000)
    time.sleep(2.5)
    assert keyed_cache.entries(spark, checkpoint).count() == 0
    put([("a", 1, 1, False)])  # within two seconds by its own time, but not by the clock
    got = run(2000)
    assert got["a"][1:] == (0, 2) and got.get("b", ("expired",))[0] == "expired"


def test_evictions_on_the_state_equal_those_of_the_log(spark, stream):
    put, run, checkpoint = stream
    day = 86_400_000
    log = [(f"k{i * i % 37}", 7 * i, i % 50, False) for i in range(400)]
    put(log[:150])
    run(day)
    put(log[150:])
    run(day)
    batch = spark.createDataFrame([(k, BASE + s * 1000, size) for k, s, size, _ in log], "key string, ms long, size long").groupBy("key").agg(F.max("ms").alias("last_ms"), F.count("*").alias("accesses"), F.sum("size").alias("size"))
    state = keyed_cache.entries(spark, checkpoint)
    assert sorted(map(tuple, state.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    now = BASE + 3_000_000
    ready = lambda df: cache.scored(df.withColumn("relevance", F.lit(0.5)), now, day)
    for choose in (lambda s: cache.evict_until(s, 900), cache.bottom_share, lambda s: cache.evictions_by_policy(s, "lfu", now, day)):
        a, b = ({r.key for r in choose(ready(df)).collect()} for df in (state, batch))
        assert a == b
    gone = cache.bottom_share(ready(state))
    names = {r.key for r in gone.collect()}
    put([(r.k, int(r["at"].timestamp()) - BASE // 1000, 0, r.gone) for r in keyed_cache.tombstones(gone, "k", "at", now).collect()])
    run(day)
    assert names and {r.key for r in keyed_cache.entries(spark, checkpoint).collect()} == {r.key for r in batch.collect()} - names
