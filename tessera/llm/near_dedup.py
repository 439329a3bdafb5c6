"""Near-duplicate groups by HyperMinHash: compressed registers, banded, estimated, then verified on the full sets.

A text's set is its distinct shingles of ``n_words`` consecutive words. The hashes of a set fall into 128 buckets; a
bucket's register holds the leading-zero count of its smallest hash and the ten bits after the leading one. Empty
buckets borrow the register of another bucket in an order fixed per bucket. 32 bands of 4 registers make the
candidates: two sets with similarity 0.8 share no band with probability 5e-8.

Texts with the same words are one class from the start. In each bucket of a band every class is compared with the
bucket's smallest class only; classes of one bucket that this leaves in different components are then compared pairwise
where they share a rare shingle or have enough frequent ones for a link, so no link is lost and a bucket of mutual
copies never makes all its pairs. A pair must reach the threshold less
``MARGIN`` in the collision-corrected estimate before its full sets are compared.

Defined results: null text, or text without a word, has an empty set and is linked with nothing; with fewer words than
a shingle the whole sequence is the one shingle; a null key takes no part (component null, not kept); repeated rows of a
key get the same result each.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Batches, WordHash, as_bytes, mix, settle, words_of
from tessera.operators.graph import connected_components

BUCKET_BITS, MANTISSA, BANDS = 7, 10, 32
M = 1 << BUCKET_BITS
#: Six standard deviations of an estimate from 128 registers.
MARGIN = 0.21
#: A shingle of at most so many sets is rare: pairs that share one are enumerated.
RARE = 8
_EDGES = np.arange(M, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_BORROW = np.stack([np.argsort(mix(np.arange(M, dtype=np.uint64) + np.uint64(1000 * (b + 1)), 7), kind="stable") for b in range(M)])


def shingles(text: bytes | None, hashes: WordHash, n_words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    k = min(n_words, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(mix(total))


def registers(sh: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits of a non-empty set."""
    at = np.minimum(np.searchsorted(sh, _EDGES), len(sh) - 1)
    low = sh[at]
    full = (low >> np.uint64(64 - BUCKET_BITS)) == np.arange(M, dtype=np.uint64)
    part, exponent = np.frexp((low & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64))
    zeros = np.clip(64 - BUCKET_BITS - exponent, 0, 63).astype(np.uint16)
    reg = (zeros << np.uint16(MANTISSA)) | np.clip((part - 0.5) * (2 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    if not full.all():
        reg = np.where(full, reg, reg[_BORROW[np.arange(M), full[_BORROW].argmax(1)]])
    return reg


@lru_cache(maxsize=4096)
def chance(load_a: float, load_b: float) -> float:
    """Probability that registers of two disjoint sets agree, for 2**load hashes a bucket."""
    lead = 2.0 ** -np.arange(1, 60)[:, None]
    lo = (lead * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))).ravel()
    hi = lo + np.repeat(lead.ravel() / (1 << MANTISSA), 1 << MANTISSA)
    p = [np.exp(n * np.log1p(-lo)) - np.exp(n * np.log1p(-np.minimum(hi, 1 - 1e-16))) for n in (2.0**load_a, 2.0**load_b)]
    return float((p[0] * p[1]).sum())


def estimate(sig_a: bytes, sig_b: bytes, n_a: int, n_b: int) -> float:
    """Collision-corrected Jaccard estimate."""
    same = float((np.frombuffer(sig_a, np.uint16) == np.frombuffer(sig_b, np.uint16)).mean())
    load = [round(np.log2(max(n / M, 1)) * 2) / 2 for n in (n_a, n_b)]
    c = chance(min(load), max(load))
    return (same - c) / (1 - c)


def sketches(docs: DataFrame, key: str, text: str, n_words: int) -> DataFrame:
    """key, f1, f2 (128-bit hash of the word sequence), n_shingles, sig."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        hashes = WordHash()
        for b in batches:
            f1, f2, n, sig = [], [], [], []
            for t in as_bytes(b.column(1)):
                sh = shingles(t, hashes, n_words)
                x = xxhash.xxh3_128_intdigest(b" ".join(words_of(t)))
                f1.append((x >> 64) - (1 << 63))
                f2.append((x & ((1 << 64) - 1)) - (1 << 63))
                n.append(len(sh))
                sig.append(registers(sh).tobytes() if len(sh) else None)
            hashes.trim()
            yield pa.RecordBatch.from_pydict({key: b.column(0), "f1": pa.array(f1, pa.int64()), "f2": pa.array(f2, pa.int64()), "n_shingles": pa.array(n, pa.int64()), "sig": pa.array(sig, pa.binary())})

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, f1 long, f2 long, n_shingles long, sig binary")


def _likely(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate reaches the least."""
    side = lambda x: sketch.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            keep = [estimate(*x) >= least for x in zip(cols[2], cols[3], cols[4], cols[5], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    kind = sketch.schema["rep"].dataType.simpleString()
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b", "n_a", "n_b").mapInArrow(run, f"a {kind}, b {kind}")


def _linked(pairs: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Pairs whose full sets meet 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches: Batches) -> Batches:
        hashes, sets = WordHash(), OrderedDict()

        def of(key: int, text: bytes) -> np.ndarray:
            if key not in sets:
                sets[key] = shingles(text, hashes, n_words)
                if len(sets) > 64:
                    sets.popitem(last=False)
            return sets[key]

        for b in batches:
            keep = []
            for i, j, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
                x, y = of(i, s), shingles(t, hashes, n_words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            hashes.trim()
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    kind = texts.schema["rep"].dataType.simpleString()
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def _bands() -> Column:
    """The 32 band hashes of a sketch."""
    width = 2 * M // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))


def _remaining(rest: DataFrame, near: DataFrame, texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in ``rest`` (h, rep, component: buckets of bands) that can have a link.

    With the numbers of sets in ``rest`` that hold a shingle, a pair either shares a rare one (at most ``RARE`` sets) and
    is found there, or its intersection is at most the smaller number of frequent shingles of the two, which must allow a
    link; those pairs meet in the first band they share. This drops no link, but it drops copies edited so much that they
    only resemble a group and would otherwise be compared with all of it.
    """
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        hashes = WordHash()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, hashes, n_words).view(np.int64) for t in as_bytes(b.column(1))], pa.list_(pa.int64()))], names=["rep", "s"])
            hashes.trim()

    member = rest.select("rep", "component").distinct()
    each = settle(texts.join(member, "rep", "left_semi").select("rep", "text").mapInArrow(run, f"rep {kind}, s array<long>").select("rep", F.explode("s").alias("s")))
    df = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    known = each.join(df, "s")

    rare = known.where(F.col("df") <= RARE).select("s", "rep").join(member, "rep")
    x, y = rare.alias("x"), rare.alias("y")
    by_shingle = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.component") < F.col("y.component"))).select("x.rep", F.col("y.rep").alias("other"))

    held = known.where(F.col("df") > RARE).groupBy("rep").agg(F.count("*").alias("held"))
    able = held.join(near.select("rep", "n_shingles", _bands().alias("bands")), "rep").where(100 * F.col("held") >= percent * F.col("n_shingles"))
    some = rest.join(settle(able), "rep")
    x, y = some.alias("x"), some.alias("y")
    least = F.least("x.held", "y.held")
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), F.lit(True)) == F.array_position("x.bands", F.col("x.h"))
    possible = (F.col("x.component") < F.col("y.component")) & (100 * least >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles") - least)) & first
    by_band = x.join(y, (F.col("x.h") == F.col("y.h")) & possible).select("x.rep", F.col("y.rep").alias("other"))
    return by_shingle.union(by_band).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept (key = component_id), one row per row of docs."""
    docs = docs.select(F.col(key), F.col(text).alias("text"))
    sketch = settle(sketches(docs, key, "text", n_words))
    some = sketch.where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    classes = settle(some.groupBy("f1", "f2").agg(F.min(key).alias("rep")))
    own = some.dropDuplicates([key]) if _repeats(some, key) else some
    reps = settle(own.join(classes.select(F.col("rep").alias(key)), key, "left_semi").select(F.col(key).alias("rep"), "n_shingles", "sig"))

    banded = reps.select("rep", F.explode(_bands()).alias("h"))
    pivots = banded.groupBy("h").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("h", "pivot")
    shared = settle(banded.join(pivots, "h"))  # only buckets with company
    star = settle(shared.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    wanted = shared.select("rep").distinct()
    whole = docs.withColumnRenamed(key, "rep").join(wanted, "rep", "left_semi").select("rep", "text")
    texts = settle(whole.dropDuplicates(["rep"]) if own is not some else whole)
    near = reps.join(wanted, "rep", "left_semi")
    near = settle(near)

    least = percent / 100 - MARGIN
    links = settle(_linked(_likely(star, near, least), texts, n_words, percent))
    found = connected_components(links, settle, "a", "b")
    found = settle(found)

    # what one bucket holds of several components: compared pairwise, once, with only what has not been compared
    comp = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = comp.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    rest = settle(comp.join(mixed, "h"))
    pairs = _remaining(rest, near, texts, n_words, percent).join(star, ["a", "b"], "left_anti")
    more = settle(_linked(_likely(pairs, near, least), texts, n_words, percent))
    if not more.isEmpty():
        found = settle(connected_components(links.union(more), settle, "a", "b"))

    out = sketch.select(key, "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.coalesce("component", "rep")).otherwise(F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _repeats(df: DataFrame, key: str) -> bool:
    """Whether a key occurs on several rows."""
    return not df.groupBy(key).count().where("count > 1").isEmpty()


def oracle_sql(n_words: int = 4, percent: int = 80) -> str:
    """DuckDB SQL: every pair that shares a shingle, components by recursion."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(n_words))
    return f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n_words} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {n_words - 2}), lambda i: {shingle}) end) g from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {percent} * (a.n + b.n - c)),
u as (select x a, y b from e union select y, x from e),
r as (select a, a b from u union select r.a, u.b from r join u on u.a = r.b),
m as (select a doc_id, min(b) component_id from r group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(component_id, d.doc_id) component_id, coalesce(component_id, d.doc_id) = d.doc_id kept from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id"""
