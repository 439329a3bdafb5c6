"""Importance resampling towards a target distribution, with integer scores and exact ranks.

Features are the runs of one to three consecutive words, hashed into buckets. A bucket's gain is the log ratio of its
counts in the target and in the documents, in thousandths; a text's weight is the sum of its features' gains, looked up
in an array of all buckets. The score adds Gumbel noise that depends on the key and a seed alone. Scores are integers, so
the histogram of scores is exact: its suffix sums are the rank offset of every score, the score at which they reach the
number to draw is the cutoff, and documents of one surviving score are numbered by their key.

Bounded: the driver holds one count for each bucket (a parameter) and one for each range of scores. A score that many
documents share is ranked in ranges of its keys.
Defined results: null or empty text has no feature and weight 0; a null key's noise is that of the seed alone, and null
keys come last among ties; rows of a repeated key share their noise and are ranked each by itself (of equal rows any one
comes first); without enough words for one draw nothing is drawn; an empty target or table gives its defined sums (all
gains follow from counts of 0); columns with clashing names are never read; a very long text is taken in slices, whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import HASH_CACHE, Batches, as_bytes, settle

BUCKETS = 10_000
#: Words of a feature at most.
GRAM_WORDS = 3
#: Bytes of a text that are split into words at once.
SLICE = 4 << 20
#: Upper case ASCII to lower case, every other ASCII byte that is no letter or digit to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class WordCrc(dict):
    """crc32 of a word in the low 32 bits, its length above them, remembered; ``trim`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        self[word] = v = len(word) << 32 | zlib.crc32(word)
        return v

    def trim(self) -> None:
        if len(self) > HASH_CACHE:
            self.clear()


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    """A crc register (without its two inversions) after one zero byte."""
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


def _applied(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache(4096)
def _shift(n: int) -> np.ndarray:
    """What n zero bytes make of each of the four bytes of a crc; linear, so the four are combined by exclusive or."""
    if n == 0:
        return np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    half = _shift(n // 2)
    twice = _applied(half, half)
    return _zero_byte(twice) if n % 2 else twice


def _joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of a text that follows another one, from the crc32 of both and the length of the second."""
    if not len(right):
        return right
    sizes, at = np.unique(lengths, return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in sizes]).reshape(-1)
    at = at * 1024
    out = right.copy()
    for k in range(4):
        out ^= tables[at + (k * 256) + (left >> np.uint32(8 * k) & np.uint32(255))]
    return out


def slices(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in slices that end between words."""
    start, end = 0, len(text or b"")
    while start < end:
        folded = text[start : start + SLICE].translate(FOLD)
        if start + SLICE < end and (cut := folded.rfind(b" ")) > 0:
            folded = folded[:cut]
        elif start + SLICE < end:  # one word longer than a slice
            rest = text[start:].translate(FOLD)
            cut = rest.find(b" ", SLICE)
            folded = rest if cut < 0 else rest[:cut]
        start += len(folded)
        yield folded.split()


def features(text: bytes | None, crcs: WordCrc, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them) for each slice of a text."""
    before = np.zeros(0, np.int64)
    space = np.array([zlib.crc32(b" ")], np.uint32)
    for words in slices(text):
        if not words:
            continue
        packed = np.concatenate([before, np.fromiter(map(crcs.__getitem__, words), np.int64, len(words))])
        crc, length, new = (packed & 0xFFFFFFFF).astype(np.uint32), packed >> 32, len(before)
        found = [crc[new:]]
        spaced = _joined(np.repeat(space, len(crc)), crc, length)  # a space and the word
        run = crc
        for n in range(1, GRAM_WORDS):
            run = _joined(run[:-1], spaced[n:], length[n:] + 1)
            found.append(run[max(0, new - n) :])  # those whose last word is new
        before = packed[-(GRAM_WORDS - 1) :]
        yield len(words), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of every bucket, over every row of (text): each task sums its own before anything is shuffled."""

    def count(batches: Batches) -> Batches:
        total, crcs = np.zeros(buckets, np.int64), WordCrc()
        for b in batches:
            held, size = [], 0
            for t in as_bytes(b.column(0)):
                for _, found in features(t, crcs, buckets):
                    held.append(found)
                    size += len(found)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=buckets)
            crcs.trim()
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(i, pa.int64()), "n": pa.array(total[i], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket under the target's and the raw model, both smoothed by one."""
    size = len(raw)
    s_all, t_all = float(int(raw.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(key: str | None, seed: int) -> int:
    """floor(1000 * Gumbel noise), from the first eight hex digits of the SHA-256 of seed and key."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """key, n_words, n_features, weight and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        crcs, gain = WordCrc(), shared.value
        for b in batches:
            rows = []
            for k, t in zip(b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                n_words = n_features = weight = 0
                for n, found in features(t, crcs, len(gain)):
                    n_words, n_features, weight = n_words + n, n_features + len(found), weight + int(gain[found].sum())
                rows.append((n_words, n_features, weight, weight + gumbel(k, seed)))
            crcs.trim()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=[key, "n_words", "n_features", "weight", "score"])

    return docs.select(key, F.col(key).cast("string").alias("_key_text"), text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long, score long")


def score_offsets(scored: DataFrame) -> DataFrame:
    """score, n and offset: how many rows have the score and how many a greater one.

    The histogram's suffix sums: within ranges of the scores by a window, between them by one count a range.
    """
    hist = scored.groupBy("score").agg(F.count("*").alias("n"))
    placed = settle(hist.repartitionByRange(F.desc("score")).withColumn("_part", F.spark_partition_id()))
    above, starts = 0, []
    for r in placed.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():
        starts.append((r["_part"], above))
        above += r["n"]
    first = scored.sparkSession.createDataFrame(starts, "_part int, _first long")
    within = Window.partitionBy("_part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_above", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return summed.join(F.broadcast(first), "_part").select("score", "n", (F.col("_first") + F.col("_above")).alias("offset"))


def draw(scored: DataFrame, k: int, key: str) -> DataFrame:
    """scored with ``rank`` from 1 to k: highest scores first, ties to the smaller key, null keys last; null beyond k.

    Rows of one score are dealt out by ranges of their keys, so that a score which very many share fills no task: a row's
    rank is its score's offset, the rows of that score in earlier ranges, and its number within its range.
    """
    offsets = settle(score_offsets(scored))
    cutoff = offsets.where(F.col("offset") < k).agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.asc_nulls_last(key), F.asc("weight"), F.asc("n_features")]
    alive = scored.where(F.col("score") >= cutoff).withColumn("_row", F.monotonically_increasing_id())
    placed = settle(alive.repartitionByRange(F.desc("score"), *order, F.col("_row")).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy("score").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy("score", "_part").agg(F.count("*").alias("_n")).withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    starts = groups.join(offsets.select("score", "offset"), "score").select("score", "_part", (F.col("offset") + F.col("_earlier")).alias("_start"))
    number = F.row_number().over(Window.partitionBy("score", "_part").orderBy(*order, "_row"))
    ranked = placed.withColumn("_number", number).join(starts, ["score", "_part"]).withColumn("rank", F.col("_start") + F.col("_number"))
    ranked = ranked.select(*scored.columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return scored.where(F.col("score") < cutoff).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """key, n_features, weight, score and rank, one row per row of docs; floor(percent / 100) of those with ``min_words`` words are drawn."""
    gain = gains(counts(docs.select(text), buckets), counts(target.select(target_text), buckets))
    scored = settle(scores(docs, gain, key, text, seed))
    enough = scored.where(F.col("n_words") >= min_words)
    few = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    ranked = draw(enough, percent * enough.count() // 100, key)
    return ranked.unionByName(few).select(key, "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """The same rows by DuckDB: every feature is written out, and its crc32 is the exclusive or of what each byte adds at its distance from the end."""
    return r"""
with recursive step(b, i, v) as (
  select b, 0, b from range(256) t(b)
  union all
  select b, i + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from step where i < 8),
byte as (select b, v from step where i = 8),
word as materialized (
  select src, id, w, len(w) as n from (
    select src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from (select 0 as src, row_number() over () as id, text from documents union all select 1, row_number() over (), text from benchmark))),
place as (select src, id, w, n, unnest(range(1, n + 1)) as i from word where n > 0),
feature as materialized (
  select src, id, unnest([w[i], case when i + 1 <= n then w[i] || ' ' || w[i + 1] end, case when i + 2 <= n then w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end]) as f from place),
each as materialized (select f, hex(encode(f)) as h from (select distinct f from feature where f is not null)),
longest as (select coalesce(max(len(h) // 2), 0) as m from each),
far(b, k, v) as (
  select b, 0, v from byte
  union all
  select far.b, far.k + 1, xor(far.v >> 8, byte.v) from far join byte on byte.b = far.v & 255 where far.k < (select m from longest)),
start(k, v) as (
  select 0, 4294967295::bigint
  union all
  select start.k + 1, xor(start.v >> 8, byte.v) from start join byte on byte.b = start.v & 255 where start.k < (select m from longest)),
hexed as (select k, upper(lpad(to_hex(b), 2, '0')) as x, v from far),
piece as (select f, len(h) // 2 as n, unnest(range(len(h) // 2)) as p, h from each),
hashed as materialized (
  select f, (xor(xor(bit_xor(hexed.v), any_value(start.v)), 4294967295)) % 10000 as bucket
  from piece join hexed on hexed.k = piece.n - 1 - piece.p and hexed.x = substr(piece.h, 2 * piece.p::int + 1, 2) join start on start.k = piece.n
  group by f),
counted as (
  select b as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range(10000) r(b)
  left join (select bucket, count(*) filter (src = 0) as s, count(*) filter (src = 1) as t from feature join hashed using (f) group by bucket) c on c.bucket = r.b),
total as (select sum(s)::double as s_all, sum(t)::double as t_all from counted),
gain as materialized (select bucket, floor(1000 * ln((t + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000))))::bigint as g from counted, total),
weighed as (select id, count(*) as n_features, sum(g)::bigint as weight from feature join hashed using (f) join gain using (bucket) where src = 0 group by id),
noise as (
  select row_number() over () as id, doc_id, ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from documents),
scored as (
  select noise.doc_id, word.n, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score
  from noise join word on word.src = 0 and word.id = noise.id left join weighed on weighed.id = noise.id),
ranked as (select *, row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) as r, count(*) over (partition by n >= 20) as c from scored)
select doc_id, n_features, weight, score, case when n >= 20 and r <= 5 * c // 100 then r end as rank from ranked
"""
