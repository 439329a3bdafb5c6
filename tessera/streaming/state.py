"""Streaming analogues: a keyed cache with time to live, file changes merged into fact tables, windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def cache_stream(events: DataFrame, key: str, ts: str, ttl_s: int, gone: str | None = None) -> DataFrame:
    """key, hits, misses after each micro-batch: an access hits if the key's last one is at most ttl_s seconds of event time old.

    The state of a key is its last access and two counters; it goes when the watermark passes the time to live. ``events``
    must have a watermark on ``ts``. Rows whose boolean column ``gone`` is true are no accesses but drop the key's entry, so
    its next access misses (after accesses of the same moment); all keys are cleared by such a row for each of them.
    """
    events = events.select(key, ts, (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hits, misses = state.get if state.exists else (-1, 0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted((t.value // 1000, bool(g)) for f in frames for t, g in zip(f[ts], f["gone"], strict=True))
        for t, dropped in times:
            if dropped:
                last = -1
                continue
            hit = last >= 0 and t - last <= ttl_s * 1_000_000
            hits, misses, last = hits + hit, misses + (not hit), t
        state.update((last, hits, misses))
        state.setTimeoutTimestamp(max(times[-1][0] // 1000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]], "hits": [hits], "misses": [misses]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, hits long, misses long", "last long, hits long, misses long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, window: str, late: str) -> DataFrame:
    """window start, by, n: tumbling counts with a watermark (an extension; the batch form is the same expression)."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(F.window(ts, window)["start"].alias("window_start"), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, session start and end, n."""
    w = events.withWatermark(ts, late) if events.isStreaming else events
    return w.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def watch_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Stream of (file_path, content, modified_at) of new and changed text files of a folder."""
    s = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    return s.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))


def reanalyse_on_change(changes: DataFrame, analyse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Start a query that replaces the facts of each changed file in the table at ``target`` (partitioned by batch, newest batch of a file wins)."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        analyse(batch.groupBy("file_path").agg(F.max_by("content", "modified_at").alias("content"))).withColumn("batch", F.lit(batch_id)).write.mode("append").partitionBy("batch").parquet(target)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, target: str) -> DataFrame:
    """Facts of the newest batch of every file."""
    f = spark.read.parquet(target)
    newest = f.groupBy("file_path").agg(F.max("batch").alias("batch"))
    return f.join(newest, ["file_path", "batch"], "left_semi")


def append_feedback(feedback: DataFrame, target: str, checkpoint: str, on_full: Callable[[DataFrame], None] | None = None, every: int = 100):
    """Start a query that appends feedback (query, symbol, relevance) to the table at ``target``; ``on_full`` gets the table whenever it has passed another ``every`` rows.

    A batch that is tried again replaces its own part, so no row counts twice; ``on_full`` may be called again for it.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.select("query", "symbol", "relevance", F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        held = batch.sparkSession.read.parquet(target)
        total, own = held.count(), held.where(F.col("batch") == batch_id).count()
        if on_full and total // every > (total - own) // every:
            on_full(held)

    return feedback.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
