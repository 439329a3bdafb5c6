"""Language-model scores from a log-frequency Bloom filter that holds quantised n-gram counts.

The filter stores for every n-gram, from count 1 on, one entry per level of its count (levels are integers at first,
then geometric), so a count is read back by probing level 1, 2, ... until a miss. There are two filters, of unigrams
(fine levels) and of bigrams (coarse levels), each sized by its n-grams and split by ranges of their hashes: a task
builds the segment of one range and reads back the counts of all n-grams that the chunks ask of it. The model interpolates

    p(w | v) = lam(v) * c'(v, w) / c(v) + (1 - lam(v)) * (c'(w) + 1) / (N + V + 1)

where c' is the quantised count, which never exceeds the true one, so the probabilities of a context sum to at most one
but for false positives of the filter. lam depends on the frequency class of v and maximises the leave-one-out
likelihood of all training bigrams (EM over a table of counts by class, which all training text feeds). The context of a
text's first word is the end token.

Counting: texts are dealt into chunks of about 4 MB by a hash of the key, those of a chunk that a null or repeated key
makes too large by a number of their own; a chunk sends each range of hashes its distinct tokens with their
training counts as one binary block, and gets the totals and the levels read from the filter back in the same order. So
a frequent word is one entry per chunk, and counts reach every text without a broadcast. Bigrams go the same way.

Bounded: a segment, by ``max_filter_bytes``: the n-grams are split into more ranges where the text is larger. An
n-gram has at most as many entries as occurrences, so both filters grow with the text and nothing is left out of them.
Defined results: null text is empty and consists of the end token; where ``train`` is null (as for a null key) a row is
no training text; without training text N = V = 0 and every token has probability 1 (log 0); rows of a repeated key
are counted and scored each; a very long text is scored whole and makes its chunk as much larger; an empty table gives no
row; columns with clashing names are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHash, as_bytes, mix, settle, words_of

CHUNK_BYTES = 4 << 20
PROBES, BITS = 5, 16
MAX_FILTER_BYTES = 192 << 20
#: Not a word: words hold no white space.
END = xxhash.xxh3_64_intdigest(b"\n")
CLASSES = 32


def levels(base: float, first: int) -> np.ndarray:
    """Count thresholds: first, first + 1, ..., then growing by the base."""
    out = [first]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * base)))
    return np.array(out, np.int64)


#: Growth of the levels.
UNIGRAM_BASE, BIGRAM_BASE = 1.05, 1.15


def _spots(keys: np.ndarray, level: int | np.ndarray, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit positions of the probes, one array per probe."""
    level = np.asarray(level, np.uint64)
    h = mix(keys ^ (level * np.uint64(0xD6E8FEB86659FD93)))
    g = mix(h, 99) | np.uint64(1)
    size = np.asarray(size, np.uint64)
    for _ in range(PROBES):
        yield (((h >> np.uint64(32)) * size) >> np.uint64(32)).astype(np.int64)
        h = h + g


def segment(keys: np.ndarray, counts: np.ndarray, thresholds: np.ndarray) -> bytes:
    """The filter's bits for the keys of one bucket."""
    n_levels = np.searchsorted(thresholds, counts, side="right")
    bits = np.zeros(max(8, -(-int(n_levels.sum()) * BITS // 8) * 8), np.uint8)
    for level in range(1, int(n_levels.max(initial=0)) + 1):
        for spots in _spots(keys[n_levels >= level], level, len(bits)):
            bits[spots] = 1
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass(frozen=True)
class LogFrequencyFilter:
    bits: np.ndarray
    offset: np.ndarray  # first byte of each bucket's segment, and the end
    shift: int  # bits of a key below its bucket
    thresholds: np.ndarray

    def _holds(self, keys: np.ndarray, level: int | np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Membership of (key, level): the first probe for all, the others for what passes it."""
        out = np.ones(len(keys), bool)
        level = np.broadcast_to(level, len(keys))
        test = lambda s, b: ((self.bits[b + (s >> 3)] >> (s & 7).astype(np.uint8)) & 1).astype(bool)
        out &= test(next(_spots(keys, level, size)), base)
        left = np.flatnonzero(out)
        probes = _spots(keys[left], level[left], size[left])
        next(probes)
        for s in probes:
            out[left] &= test(s, base[left])
        return out

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key's count: probes levels 1, 2, 4, ... until a miss, then halves the range in between; 0 if level 1 misses."""
        bucket = (keys >> np.uint64(self.shift)).astype(np.int64)
        base, size = self.offset[bucket], (self.offset[bucket + 1] - self.offset[bucket]) * 8
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.thresholds) + 1)
        left, level = np.flatnonzero(size > 0), 1
        while len(left):
            hit = self._holds(keys[left], level, base[left], size[left])
            high[left[~hit]] = level
            left = left[hit]
            low[left] = level
            if level == len(self.thresholds):
                high[left] = level + 1
                break
            level = min(level * 2, len(self.thresholds))
        left = np.flatnonzero((high - low > 1) & (low > 0))
        while len(left):
            middle = (low[left] + high[left]) // 2
            hit = self._holds(keys[left], middle, base[left], size[left])
            low[left[hit]] = middle[hit]
            high[left[~hit]] = middle[~hit]
            left = left[high[left] - low[left] > 1]
        return low

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised count of each key."""
        return count_of(self.found(keys), self.thresholds)


def count_of(level: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    return np.where(level > 0, thresholds[np.maximum(level, 1) - 1], 0)


def _filter(parts: dict[int, bytes], buckets: int, thresholds: np.ndarray) -> LogFrequencyFilter:
    sizes = [len(parts.get(i, b"")) for i in range(buckets)]
    return LogFrequencyFilter(np.frombuffer(b"".join(parts.get(i, b"") for i in range(buckets)) or b"\0", np.uint8), np.concatenate([[0], np.cumsum(sizes)]), 64 - int(math.log2(buckets)), thresholds)


def _levels(keys: np.ndarray, counts: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Builds the segment of one range from the keys that have a count, and reads back the level of every key."""
    seen = counts > 0
    bits = segment(keys[seen], counts[seen], thresholds) if seen.any() else b""
    return _filter({0: bits}, 1, thresholds).found(keys).astype(np.uint16)


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts) of a range's chunks -> its distinct keys, their totals, the place of each chunk's keys among them, and where a chunk's end."""
    keys = [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]
    every, inverse = distinct(np.concatenate(keys))
    sums = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.int32) for x in t.column("counts").to_pylist()]), len(every)).astype(np.int64)
    return every, sums, inverse, np.cumsum([len(k) for k in keys])[:-1]


def hashes_of(text: bytes | None, hashes: WordHash) -> np.ndarray:
    return np.append(hashes.of(words_of(text)), np.uint64(END))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the place of each element among them."""
    codes, values = pd.factorize(h)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return values[order], rank[codes]


def _blocks(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """bucket, chunk, keys, counts: what a chunk sends each range of hashes."""
    rows = _slices(keys, buckets)
    counts = counts.astype(np.int32)
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array([keys[s].tobytes() for _, s in rows], pa.binary()), "counts": pa.array([counts[s].tobytes() for _, s in rows], pa.binary())})


def _joined(reply: pa.Table, kind: int, column: str, dtype: type) -> np.ndarray:
    """The replies of one kind to a chunk, in the order of its sorted keys."""
    got = sorted((b, x) for k, b, x in zip(*(reply.column(c).to_pylist() for c in ("kind", "bucket", column)), strict=True) if k == kind)
    return np.frombuffer(b"".join(x for _, x in got), dtype)


def _slices(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Bucket and place of each range of sorted keys that is not empty."""
    edges = np.searchsorted(keys, np.arange(1, buckets, dtype=np.uint64) << np.uint64(64 - int(math.log2(buckets))))
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
    return [(i, slice(int(s), int(e))) for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s < e]


def frequency_class(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 0) + 1.0).astype(np.int64), CLASSES - 1)


def bigrams(h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Key of each bigram of texts in a row: 54 bits of hash, the classes of both words below. A text's first word has the end token before it: each text ends with one, and the last text's goes to the front."""
    v, cv = np.roll(h, 1), np.roll(cls, 1)
    return (mix(v * np.uint64(3) + h, 5) & np.uint64(0xFFFFFFFFFFFFFC00)) | (cv.astype(np.uint64) << np.uint64(5)) | cls.astype(np.uint64)


def _count_class(c: np.ndarray) -> np.ndarray:
    """Counts below 16 as they are, above in quarters of an octave."""
    return np.where(c < 16, c, 16 + np.floor((np.log2(np.maximum(c, 1)) - 4) * 4)).astype(np.int64)


def _class_count(k: np.ndarray) -> np.ndarray:
    return np.where(k < 16, k, 2.0 ** (4 + (k - 16 + 0.5) / 4))


def _chunked(docs: DataFrame, key: str, text: str, train: Column, chunks: int, chunk_bytes: int) -> DataFrame:
    """chunk, key, train, text. Chunks that one key fills are written and dealt anew by row."""
    chunk = F.pmod(F.xxhash64(F.lit(5), key), F.lit(chunks)).cast("int").alias("chunk")
    named = docs.select(chunk, F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    # beside its longest text, which cannot be dealt out
    loads = named.groupBy("chunk").agg((F.sum(size) - F.max(size)).alias("bytes")).where(F.col("bytes") > 3 * chunk_bytes).orderBy("chunk").collect()
    if not loads:
        return named
    parts = [-(-r["bytes"] // chunk_bytes) for r in loads]
    firsts = np.cumsum([chunks, *parts[:-1]]).tolist()
    hot = F.broadcast(docs.sparkSession.createDataFrame([(r["chunk"], f, p) for r, f, p in zip(loads, firsts, parts, strict=True)], "chunk int, _first long, _parts long"))
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_parts")
    dealt = settle(named.join(hot, "chunk").select((F.col("_first") + row).cast("int").alias("chunk"), "key", "train", "text"))
    return named.join(hot, "chunk", "left_anti").union(dealt)


SENT = "bucket int, chunk int, keys binary, counts binary"
UNIGRAM, BIGRAM = 1, 2
UNIGRAM_LEVELS, BIGRAM_LEVELS = levels(UNIGRAM_BASE, 1), levels(BIGRAM_BASE, 1)


def _tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: its distinct tokens, the place of each token among them, the number of tokens of each text, and whether a token is training text."""
    hashes = WordHash()
    texts = [hashes_of(x, hashes) for x in as_bytes(t.column("text").combine_chunks())] if len(t) else []
    sizes = np.array([len(h) for h in texts], np.int64)
    keys, inverse = distinct(np.concatenate(texts) if texts else np.zeros(0, np.uint64))
    return keys, inverse, sizes, np.repeat(np.array(t.column("train").to_pylist(), bool), sizes)


def _unigram_totals(chunked: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, totals and levels: training counts of the chunk's distinct tokens in that range of hashes, exact and from the filter; with chunk -1 one row per bucket: n, v."""

    def send(t: pa.Table) -> pa.Table:
        keys, inverse, _, train = _tokens(t)
        return _blocks(t.column("chunk")[0].as_py(), keys, np.bincount(inverse, train, len(keys)), buckets)

    def total(t: pa.Table) -> pa.Table:
        every, sums, inverse, ends = _merged(t)
        exact, level = np.split(sums[inverse], ends), np.split(_levels(every, sums, UNIGRAM_LEVELS)[inverse], ends)
        n = len(exact)
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * (n + 1), pa.int32()), "chunk": pa.array([*t.column("chunk").to_pylist(), -1], pa.int32()), "totals": pa.array([*[x.tobytes() for x in exact], b""], pa.binary()), "levels": pa.array([*[x.tobytes() for x in level], b""], pa.binary()), "n": pa.array([*[0] * n, int(sums.sum())], pa.int64()), "v": pa.array([*[0] * n, int((sums > 0).sum())], pa.int64())})

    sent = chunked.groupBy("chunk").applyInArrow(send, SENT)
    return sent.groupBy("bucket").applyInArrow(total, "bucket int, chunk int, totals binary, levels binary, n long, v long")


def _bigram_levels(chunked: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, levels: training counts of the chunk's distinct bigrams in that range of hashes, from the filter; with chunk -1 cell, n: training bigrams by classes of both words and count."""

    def send(t: pa.Table, reply: pa.Table) -> pa.Table:
        keys, inverse, _, train = _tokens(t)
        cls = frequency_class(count_of(_joined(reply, UNIGRAM, "levels", np.uint16), UNIGRAM_LEVELS))
        grams, place = distinct(bigrams(keys[inverse], cls[inverse]))
        return _blocks(t.column("chunk")[0].as_py(), grams, np.bincount(place, train, len(grams)), buckets)

    def total(t: pa.Table) -> pa.Table:
        every, sums, inverse, ends = _merged(t)
        level = np.split(_levels(every, sums, BIGRAM_LEVELS)[inverse], ends)
        seen = sums > 0
        cell, n = np.unique((_count_class(sums[seen]) << 10) | (every[seen] & np.uint64(0x3FF)).astype(np.int64), return_counts=True)
        rows, k = len(level), len(cell)
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * (rows + k), pa.int32()), "chunk": pa.array([*t.column("chunk").to_pylist(), *[-1] * k], pa.int32()), "levels": pa.array([*[x.tobytes() for x in level], *[b""] * k], pa.binary()), "cell": pa.array([*[0] * rows, *cell], pa.int64()), "n": pa.array([*[0] * rows, *n], pa.int64())})

    sent = chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, SENT)
    return sent.groupBy("bucket").applyInArrow(total, "bucket int, chunk int, levels binary, cell long, n long")


def _fit_lam(cells: np.ndarray, n: np.ndarray, total: int, vocab: int) -> np.ndarray:
    """EM for the weight of the bigram estimate, by class of the context: leave-one-out over all training bigrams."""
    lam = np.full(CLASSES, 0.0)
    if not len(cells):
        return lam
    c, cv, cw = _class_count(cells >> 10), (cells >> 5) & 31, cells & 31
    of = lambda k: 2.0 ** (k + 0.5) - 1  # noqa: E731  the middle of a class
    left = c - 1
    q = left / np.maximum(of(cv) - 1, np.maximum(left, 1))
    p = (np.maximum(of(cw) - 1, 0) + 1) / (total + vocab + 1)
    tokens = n * c
    lam[:] = 0.3
    for _ in range(40):
        part = lam[cv] * q / (lam[cv] * q + (1 - lam[cv]) * p)
        lam = np.bincount(cv, tokens * part, CLASSES) / np.maximum(np.bincount(cv, tokens, CLASSES), 1)
    return np.clip(lam, 0, 0.95)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, vocabulary, base_score (add-one unigrams, exact counts) and score (the model)."""
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text) + F.lit(16))).first()[0] or 0
    chunks = max(8, -(-size // chunk_bytes))
    # a token takes two bytes of a filter at most and two bytes of text at least, so a range's segment is no larger than its share of the text
    buckets = 1 << max(3, math.ceil(math.log2(max(chunks / 8, size / max_filter_bytes))))
    chunked = _chunked(docs, key, text, train, chunks, chunk_bytes)

    totals = settle(_unigram_totals(chunked, buckets))
    n, v = (x or 0 for x in totals.where("chunk = -1").agg(F.sum("n"), F.sum("v")).first())
    unigrams = totals.where("chunk >= 0").select("chunk", F.lit(UNIGRAM).alias("kind"), "bucket", "totals", "levels")

    counted = settle(_bigram_levels(chunked, unigrams, buckets * 4))
    cells = counted.where("chunk = -1").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    lam = _fit_lam(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), n, v)

    def run(t: pa.Table, reply: pa.Table) -> pa.Table:
        keys, inverse, sizes, _ = _tokens(t)
        exact = _joined(reply, UNIGRAM, "totals", np.int64)
        rough = count_of(_joined(reply, UNIGRAM, "levels", np.uint16), UNIGRAM_LEVELS)
        out_of = n + v + 1
        base, uni = np.log10((exact + 1) / out_of), (rough + 1) / out_of
        ends = np.cumsum(sizes)
        rough_all = rough[inverse]
        _, place = distinct(bigrams(keys[inverse], frequency_class(rough)[inverse]))
        before = np.roll(rough_all, 1)
        seen = np.minimum(count_of(_joined(reply, BIGRAM, "levels", np.uint16), BIGRAM_LEVELS)[place], np.minimum(before, rough_all))
        lam_all = lam[frequency_class(before)]
        p = lam_all * seen / np.maximum(before, 1) + (1 - lam_all) * uni[inverse]
        add = lambda x: np.add.reduceat(x, ends - sizes) if len(sizes) else np.zeros(0)
        k = len(sizes)
        return pa.table({key: t.column("key"), "train": t.column("train"), "n_tokens": pa.array(sizes, pa.int64()), "n_known": pa.array(add((exact > 0)[inverse].astype(np.int64)).astype(np.int64), pa.int64()), "train_tokens": pa.array([n] * k, pa.int64()), "vocabulary": pa.array([v] * k, pa.int64()), "base_score": pa.array(add(base[inverse]), pa.float64()), "score": pa.array(add(np.log10(np.maximum(p, 1e-300))), pa.float64())})

    replies = unigrams.unionByName(counted.where("chunk >= 0").select("chunk", F.lit(BIGRAM).alias("kind"), "bucket", F.lit(b"").alias("totals"), "levels"))
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, f"`{key}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double")
