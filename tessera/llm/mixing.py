"""Mixing sources to target weights by the cube method.

Sources share a budget by weight; a source's share stops at ``most`` times its size, the excess being shared again.
A source's documents then have the same expected number of copies r = target / size: each is taken floor(r) times, and
once more with probability r - floor(r). The cube method draws those: it moves the inclusion probabilities through the
null space of the balancing constraints (words and documents of the source), so both totals stay at their expectation
while one probability after the other reaches 0 or 1. Documents are dealt into blocks of bounded size by a hash; each
block leaves at most three undecided, those of ``BLOCK`` blocks make the blocks of the next level, until one small
landing problem per source remains, whose best rounding is searched. So no task ever holds a source, however hot.

Everything follows from the key, a repeat's number and a seed: reruns agree. The order of the sources and the level at
which shares stop come from ranges and sums over the sources, so their number is not bound by a task either.

Defined results: null text has size 0 and is taken 0 times; a source without words has target 0; a null source is a
source of its own, last in order; rows with the same key, source and size are told apart by a number (which of them is
taken more often makes no difference to the result), so a repeated or null key is dealt into blocks like any other; an
empty table gives no row; columns with clashing names are never read; a very long text counts whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import numbered, settle

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
BLOCK, LANDING = 512, 12
EPS = 1e-9


def n_words(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target of each source, from (source, size): one row per source from the first aggregation on.

    The target is the smaller of most * size and weight * level, where the level uses up the budget. The level rises from
    an even split: sources full at it leave what they do not take to the others, until no other is full.
    """
    src = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")), F.asc_nulls_last("source"), name="rank")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int"))
    src = settle(src.select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")))
    full_at = F.col("cap") / F.col("w")
    budget = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full, rest = src.agg(F.sum(F.when(full_at <= level, F.col("cap"))), F.sum(F.when(full_at > level, F.col("w")))).first()
        new = (budget - (full or 0.0)) / rest if rest else level
        if new <= level:
            break
        level = new
    return src.select("source", "source_size", F.least("cap", F.col("w") * F.lit(float(level)) if rest else F.col("cap")).alias("target"))


def _counted(sized: DataFrame) -> DataFrame:
    """sized with ``copy``: the number, from 0, among the rows of the same key, source and size."""
    same = ["key", "source", "size"]
    again = settle(sized.groupBy(*same).count().where("count > 1"))
    if again.isEmpty():
        return sized.withColumn("copy", F.lit(0).cast("long"))
    renamed = lambda df: df.select(*[F.col(c).alias(f"_{c}") for c in same], *[c for c in df.columns if c not in same])
    meets = (F.col("key").eqNullSafe(F.col("_key"))) & (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("size") == F.col("_size"))
    once = sized.join(renamed(again), meets, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    repeated = numbered(sized.join(renamed(again), meets, "left_semi"), F.col("key"), F.col("source"), F.col("size"))
    first = renamed(repeated.groupBy(*same).agg(F.min("number").alias("_first")))
    return once.unionByName(repeated.join(first, meets).select(*same, (F.col("number") - F.col("_first")).alias("copy")))


def _direction(x: np.ndarray) -> np.ndarray:
    """A direction for three rows of two balancing variables that keeps both totals."""
    u = np.cross(x[:, 0], x[:, 1])
    size = np.abs(u).max()
    return u / size if size > EPS else np.linalg.svd(x.T)[2][-1]


def flight(p: np.ndarray, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Cube method, flight phase: three undecided rows at a time move through the null space of the two constraints.

    p: inclusion probabilities; x: balancing variables (one row each, two columns), which are divided by the first
    probabilities of the rows. At most two rows stay undecided, three where the last direction is not to be had.
    """
    p = p.copy()
    undecided = np.flatnonzero((p > EPS) & (p < 1 - EPS))[::-1].tolist()
    hand: list[int] = []
    while True:
        while len(hand) < 3 and undecided:
            hand.append(undecided.pop())
        if len(hand) < 3:
            return p
        now = p[hand]
        u = _direction(x[hand])
        room = [((1 - q) / v, q / v) if v > EPS else (-q / v, (q - 1) / v) if v < -EPS else (np.inf, np.inf) for q, v in zip(now.tolist(), u.tolist(), strict=True)]
        up, down = min(r[0] for r in room), min(r[1] for r in room)
        now = now + u * (up if draw.random() * (up + down) < down else -down)
        p[hand] = np.where(now < EPS, 0.0, np.where(now > 1 - EPS, 1.0, now))
        hand = [k for k in hand if EPS < p[k] < 1 - EPS]


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last few undecided rows: of all roundings the one whose words and documents come nearest to what they stand for."""
    k = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.round(p)
    if len(k):
        every = (np.arange(1 << len(k))[:, None] >> np.arange(len(k))) & 1
        words, rows = np.abs((every - p[k]) @ size[k]), np.abs((every - p[k]).sum(1))
        out[k] = every[np.argmin(words / max(size.mean(), 1.0) + 0.05 * rows)]
    return out


def fly_and_land(p: np.ndarray, size: np.ndarray, x: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The last block of a source: all but ``LANDING`` rows fly; those, of sizes spread over the block's, land with what the flight leaves."""
    undecided = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    by_size = undecided[np.argsort(size[undecided], kind="stable")]
    kept = by_size[np.unique(np.linspace(0, len(by_size) - 1, min(LANDING, len(by_size))).astype(int))] if len(by_size) else by_size
    held = p[kept]
    p = p.copy()
    p[kept] = 0.0
    p = flight(p, x, draw)
    p[kept] = held
    return landing(p, size)


def _decide(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level: every block flies; a source that is one block also lands. p becomes 0 or 1, or stays undecided."""

    def fly(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["h", "size"], kind="stable")
        p, size = t["p"].to_numpy(float), t["size"].to_numpy(float)
        scale = max(size.max(), 1.0)
        x, draw = np.column_stack([size / scale, np.ones(len(p))]), np.random.default_rng([seed, level, int(t["h"].iloc[0]) & 0xFFFFFFFF, len(t)])
        t["p"] = fly_and_land(p, size, x, draw) if t["blocks"].iloc[0] == 1 else flight(p, x, draw)
        return t

    return rows.groupBy("source", "block").applyInPandas(fly, rows.schema)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """key, source, size, source_size, target, copies and taken (size * copies), one row per row of docs."""
    sized = settle(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size")))
    sized = settle(_counted(sized))
    of = settle(targets(sized, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    floor = F.floor(rate + EPS)
    per = of.select(F.col("source").alias("s"), "source_size", "target", floor.alias("whole"), F.greatest(rate - floor, F.lit(0.0)).alias("p"))
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "key", "size", "copy")).drop("copy")

    left, done, level = rows, None, 0
    while True:
        n = left.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")).withColumnRenamed("source", "s")
        dealt = left.join(n, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1 + level), "h"), "blocks"))
        flown = settle(_decide(dealt, level, seed).drop("blocks", "block"))
        undecided = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided, left = flown.where(~undecided), flown.where(undecided)
        done = decided if done is None else done.union(decided)
        if left.isEmpty():
            break
        level += 1
    copies = (F.col("whole") + F.round("p")).cast("long")
    return done.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
