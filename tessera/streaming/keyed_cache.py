"""A keyed cache as a stream: entries are value state with a time to live, evictions are chosen on a snapshot of that state.

The state lives in RocksDB and in the query's checkpoint, so it survives a restart; ``entries`` reads it with Spark's
state data source as one row a key, and the batch operators of ``tessera.operators.cache`` run on those rows. What they
let go returns to the stream as rows that drop the entries.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENTRY, COUNTS = "last_ms long, accesses long, size long", "hits long, misses long"


class _Cache(StatefulProcessor):
    """One entry and two counters a key. The entry goes by itself when it was not touched for ``ttl_ms`` of the clock; a timer of the same moment reports it."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY, self.ttl_ms)
        self.counts = handle.getValueState("counts", COUNTS)

    def _out(self, key: tuple, event: str, hits: int, misses: int) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "event": [event], "hits": [hits], "misses": [misses]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits, misses = self.counts.get() if self.counts.exists() else (0, 0)
        entry = self.entry.get() if self.entry.exists() else None
        event = "access"
        for frame in rows:
            for ms, size, gone in sorted(zip(frame["ms"], frame["size"], frame["gone"], strict=True), key=lambda r: (r[0], r[2])):
                if gone:
                    entry, event = None, "dropped"
                    continue
                hit, event = entry is not None and ms - entry[0] <= self.ttl_ms, "access"
                hits, misses = hits + hit, misses + (not hit)
                entry = (max(int(ms), entry[0]), entry[1] + 1, entry[2] + int(size)) if hit else (int(ms), 1, int(size))
        self.counts.update((hits, misses))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        yield self._out(key, event, hits, misses)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield self._out(key, "expired", *(self.counts.get() if self.counts.exists() else (0, 0)))

    def close(self) -> None:
        pass


def keyed_cache(log: DataFrame, key: str, ts: str, ttl_ms: int, size: str | None = None, gone: str | None = None) -> DataFrame:
    """key, event (access, dropped, expired), hits and misses of each key that a micro-batch touched.

    An access hits if the key has an entry that is at most ``ttl_ms`` old, by the times of the accesses and by the clock; it
    renews the entry and adds its ``size`` (0 by default) to it, a miss makes a new one. Rows whose column ``gone`` is true
    drop the entry (after accesses of the same moment). Accesses are taken in the order of their times within an Arrow batch
    of a key's rows. A query that ends by itself (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled``
    off, since timers of the clock may always ask for one batch more; they then fire with the next rows. The session needs the RocksDB state store, which is set here where nothing is.
    """
    spark = log.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    flag = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    rows = log.where(F.col(ts).isNotNull()).select(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), (F.lit(0) if size is None else F.coalesce(F.col(size), F.lit(0))).cast("long").alias("size"), flag.alias("gone"))
    kind = log.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(_Cache(key, ttl_ms), f"`{key}` {kind}, event string, hits long, misses long", "Update", "ProcessingTime")


def entries(spark: SparkSession, checkpoint: str, now_ms: int | None = None) -> DataFrame:
    """key, last_ms, accesses, size of the live entries in the state of a keyed cache, as of its last finished micro-batch.

    Entries whose time to live is over at ``now_ms`` (the clock by default) are left out, as the stream would.
    """
    s = spark.read.format("statestore").option("stateVarName", "entry").load(checkpoint)
    now = int(time.time() * 1000) if now_ms is None else now_ms
    key = s.schema["key"].dataType.names[0]
    live = s.where(F.col("value.ttlExpirationMs") > now)
    return live.select(F.col(f"key.{key}").alias("key"), *[F.col(f"value.value.{c}").alias(c) for c in ("last_ms", "accesses", "size")])


def tombstones(evicted: DataFrame, key: str, ts: str, at_ms: int) -> DataFrame:
    """Rows of the log (key, ts, gone) that drop the evicted keys at a moment."""
    return evicted.select(F.col("key").alias(key), F.timestamp_millis(F.lit(at_ms)).alias(ts), F.lit(True).alias("gone"))
