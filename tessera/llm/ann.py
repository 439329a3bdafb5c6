"""Approximate nearest neighbours by an inverted multi-index, nearest meaning the largest inner product.

Both halves of a vector are quantised separately; a pair of centroids is a cell. A query visits the cells by the summed
distance (here the negative inner product, which adds up over the halves) with a heap, until they hold ``budget``
vectors; those are reranked exactly in double precision. The sum at which a query stops says which cells it visits, so a
query travels as its vector and one number.

The budget is calibrated: for a bounded sample of queries all vectors are compared, and the budget is what their true
neighbours need for the aimed recall. Every row is indexed and every asked query searched.

The index grows with the table: ``centroids_for`` gives the centroids of a half, ``shard_for`` the vectors of a shard.
Cells are packed into shards; a cell with more vectors than a shard (a very common vector) is split over several by a
hash. Queries travel to the shards that hold their cells. A task keeps one shard and streams queries past it; where more
than ``QUERY_BLOCK`` queries visit a shard, they are dealt into blocks, each with a copy of that shard, so copies are at
most one vector for every ``QUERY_BLOCK / shard`` visits and no group is larger than a shard and a block.

Bounded: centroids are fitted on ``SAMPLE`` rows, the budget on ``CALIBRATE`` queries, both chosen by a hash of the key;
a half has at most ``MOST_CENTROIDS``, so the index has at most their square in cells (2 MB of counts).
Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; a null key takes no part; of a key's repeated rows the smallest vector counts; ties go to the smaller key; an empty
table, or no query, gives no row; columns with clashing names are never read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Batches, mix, settle

SAMPLE, CALIBRATE, RECALL = 32_768, 96, 0.96
PER_CELL, LEAST_CENTROIDS, MOST_CENTROIDS = 50, 16, 512
LEAST_SHARD, MOST_SHARD, QUERY_BLOCK = 256, 32_768, 16_384
#: Scores of queries against a shard that are worked on at once.
CELLS = 1 << 21
TIE = 1e-9


def centroids_for(n: int) -> int:
    """Centroids of each half for n vectors: about ``PER_CELL`` vectors a cell."""
    return min(max(round(math.sqrt(n / PER_CELL)), LEAST_CENTROIDS), MOST_CENTROIDS)


def shard_for(n: int) -> int:
    """Vectors of a shard: 20 shards, of bounded memory for large tables, which have more. A query's candidates are at most k for each shard that it visits."""
    return min(max(n // 20, LEAST_SHARD), MOST_SHARD)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and v (array<double>) of the rows that take part."""
    v = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull())
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(ok)
    if not v.groupBy("key").count().where("count > 1").isEmpty():
        v = v.groupBy("key").agg(F.min("v").alias("v"))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return v.where(F.size("v") == sizes[0]["d"]) if len(sizes) > 1 else v


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(1)
    c = np.unique(x, axis=0)
    c = c[rng.choice(len(c), min(k, len(c)), replace=False)]
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


@dataclass(frozen=True)
class MultiIndex:
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # vectors of each cell, left x right
    first: np.ndarray  # first shard of each cell
    shards: np.ndarray  # how many shards it is split over

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.left) * len(self.right) + nearest(x[:, self.half :], self.right)

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each query to the centroids of both halves."""
        return -(q[:, : self.half] @ self.left.T), -(q[:, self.half :] @ self.right.T)


def traverse(a: np.ndarray, b: np.ndarray, counts: list[list[int]], budget: int) -> float:
    """Visit centroid pairs by a[i] + b[j] with a heap until they hold the budget; the sum of the last one."""
    order, other = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y, i_of, j_of = a[order].tolist(), b[other].tolist(), order.tolist(), other.tolist()
    heap, held, last = [(x[0] + y[0], 0, 0)], 0, -math.inf
    while heap:
        last, i, j = heapq.heappop(heap)
        held += counts[i_of[i]][j_of[j]]
        if held >= budget:
            return last
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return math.inf


def top(ids: np.ndarray, x: np.ndarray, rough: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the rows whose rough score is finite; scores summed the same way for equal vectors, so ties are ties."""
    rough = np.where(ids == own, -np.inf, rough)
    n = int(np.isfinite(rough).sum())
    if not n:
        return ids[:0], rough[:0]
    edge = np.partition(rough, len(rough) - min(k, n))[len(rough) - min(k, n)]
    near = np.flatnonzero(rough >= edge - TIE * max(1.0, abs(edge)))
    score = (x[near] * q).sum(1)
    best = np.lexsort((ids[near], -score))[:k]
    return ids[near][best], score[best]


def build(vectors: DataFrame, n: int, sample: int = SAMPLE, centroids: int | None = None, shard: int | None = None) -> MultiIndex:
    """Centroids from at most ``sample`` of the n rows; counts of cells over all rows, cells packed into shards."""
    rows = vectors.orderBy(F.xxhash64(F.lit(23), "key"), "key").limit(sample).select("v").toPandas()
    x = np.stack(rows["v"].to_numpy())
    if x.shape[1] < 2:
        x = np.column_stack([x, np.zeros(len(x))])
    half, k, most = x.shape[1] // 2, centroids or centroids_for(n), shard or shard_for(n)
    index = MultiIndex(kmeans(x[:, :half], k), kmeans(x[:, half:], k), *[np.zeros(0)] * 3)
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for r in assigned(vectors, index, place=False).groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    first, shards, at, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for c, held in enumerate(counts.tolist()):
        if filled + held > most and filled:
            at, filled = at + 1, 0
        first[c], filled = at, filled + held
        if held > most:
            shards[c] = -(-held // most)
            at, filled = at + int(shards[c]), 0
    return MultiIndex(index.left, index.right, counts.reshape(len(index.left), -1), first, shards)


def assigned(vectors: DataFrame, index: MultiIndex, place: bool = True) -> DataFrame:
    """key, v, cell and shard of every vector (shard 0 before cells are placed)."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Batches) -> Batches:
        m = shared.value
        for b in batches:
            x = matrix(b.column(1))
            x = x if x.shape[1] > 1 else np.column_stack([x, np.zeros(len(x))])
            cell = m.cells(x) if len(x) else np.zeros(0, int)
            salt = (mix(b.column(0).to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int64)
            shard = m.first[cell] + salt % m.shards[cell] if place else cell * 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(shard, pa.int32())], names=["key", "v", "cell", "shard"])

    return vectors.select(F.col("key").cast("long").alias("key"), "v").mapInArrow(run, "key long, v array<double>, cell int, shard int")


def calibrate(vectors: DataFrame, queries: DataFrame, index: MultiIndex, k: int, recall: float = RECALL, n: int = CALIBRATE) -> int:
    """Vectors a query must visit so that its true neighbours are found with the aimed recall, from n queries compared with all rows."""
    rows = queries.orderBy(F.xxhash64(F.lit(29), "key"), "key").limit(n).toPandas()
    if rows.empty:
        return 0
    own, q = rows["key"].to_numpy(np.int64), np.stack(rows["v"].to_numpy())
    shared = vectors.sparkSession.sparkContext.broadcast((own, q))

    def run(batches: Batches) -> Batches:
        own, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in own]
        for b in batches:
            ids, x, cell = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
            if len(ids):
                for i, rough in enumerate(q @ x.T):
                    found, score = top(ids, x, rough, q[i], own[i], k)
                    at = np.searchsorted(ids, found, sorter=(order := np.argsort(ids)))
                    held = [np.concatenate(y) for y in zip(best[i], (found, score, cell[order[at]]), strict=True)]
                    keep = np.lexsort((held[0], -held[1]))[:k]
                    best[i] = tuple(y[keep] for y in held)
        for i, (ids, score, cell) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i), pa.int32()), pa.array(ids, pa.int64()), pa.array(score, pa.float64()), pa.array(cell, pa.int32())], names=["i", "key", "score", "cell"])

    near = vectors.select("key", "v", "cell").mapInArrow(run, "i int, key long, score double, cell int")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "key")
    true = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("i", "cell").toPandas()
    q2 = q if q.shape[1] > 1 else np.column_stack([q, np.zeros(len(q))])
    a, b = index.sums(q2)
    need = []
    for i, cells in true.groupby("i")["cell"]:
        s = (a[i][:, None] + b[i][None, :]).ravel()
        order_ = np.argsort(s, kind="stable")
        reach = np.empty(len(s), np.int64)
        reach[order_] = np.cumsum(index.counts.ravel()[order_])
        need += reach[cells.to_numpy()].tolist()
    return int(np.quantile(need, recall, method="higher")) if need else 0


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL, centroids: int | None = None, shard: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, ``key`` and score of the k nearest of each row that ``is_query`` selects (an expression on ``key``)."""
    spark = vectors.sparkSession
    rows = settle(usable(vectors.select(F.col(key), F.col(vector)), key, vector).withColumn(key, F.col("key")).withColumn("asked", F.coalesce(is_query, F.lit(False))).drop(key))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    index = build(rows, n, centroids=centroids, shard=shard)
    stored = settle(assigned(rows, index))
    asked = rows.where("asked").select(F.col("key").cast("long").alias("key"), "v")
    budget = calibrate(stored, asked, index, k, recall)
    shared = spark.sparkContext.broadcast(index)

    def route(batches: Batches) -> Batches:
        m = shared.value
        n_shards, counts = int((m.first + m.shards).max()), m.counts.tolist()
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1))
            left, right = m.sums(q if q.shape[1] > 1 else np.column_stack([q, np.zeros(len(q))]))
            stop = [traverse(x, y, counts, budget) for x, y in zip(left, right, strict=True)]
            to = []
            for i, s in enumerate(stop):
                seen = np.zeros(n_shards, bool)
                open_ = np.flatnonzero(((left[i][:, None] + right[i][None, :]) <= s).ravel() & (m.counts.ravel() > 0))
                for j in range(int(m.shards[open_].max(initial=0))):
                    seen[m.first[open_] + np.minimum(j, m.shards[open_] - 1)] = True
                to.append(np.flatnonzero(seen).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(stop, pa.float64()), pa.array(to, pa.list_(pa.int32()))], names=["key", "v", "stop", "shards"])

    routed = settle(asked.mapInArrow(route, "key long, v array<double>, stop double, shards array<int>"))
    # one row per shard that is visited at all: as many as the index has, which every task holds anyway
    blocks = F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks")
    load = F.broadcast(settle(routed.select(F.explode("shards").alias("shard")).groupBy("shard").agg(blocks)))
    sent = routed.select(F.explode("shards").alias("shard"), "key", "v", "stop").join(load, "shard")
    sent = sent.select("shard", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.lit(1).alias("tag"), "key", "v", F.lit(0).alias("cell"), "stop")
    held = stored.join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("tag"), "key", "v", "cell", F.lit(0.0).alias("stop"))

    def rerank(batches: Batches) -> Batches:
        m, now, parts, held = shared.value, None, [], None
        for b in batches:
            place = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            tags = b.column(2).to_numpy()
            edges = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(tags, prepend=-1) != 0))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(place)], strict=True):
                if place[s] != now:
                    now, parts, held = place[s], [], None
                ids, cell, stop = (b.column(i).slice(s, e - s).to_numpy() for i in (3, 5, 6))
                x = matrix(b.column(4).slice(s, e - s))
                if tags[s] == 0:
                    parts.append((ids, x, cell))
                    continue
                held = held or tuple(np.concatenate(y) for y in zip(*parts, strict=True))
                row, col = np.divmod(held[2], len(m.right))
                step, out = max(1, CELLS // len(row)), ([], [], [])
                for i in range(0, len(ids), step):
                    q = x[i : i + step]
                    left, right = m.sums(q if q.shape[1] > 1 else np.column_stack([q, np.zeros(len(q))]))
                    rough = np.where(left[:, row] + right[:, col] <= stop[i : i + step, None], q @ held[1].T, -np.inf)
                    for j in range(len(q)):
                        found, score = top(held[0], held[1], rough[j], q[j], ids[i + j], k)
                        for y, z in zip(out, (np.full(len(found), ids[i + j]), found, score), strict=True):
                            y.append(z)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), pa.array(np.concatenate(out[2]), pa.float64())], names=["query_id", "key", "score"])

    near = held.union(sent).repartition("shard", "block").sortWithinPartitions("shard", "block", "tag").mapInArrow(rerank, "query_id long, key long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
