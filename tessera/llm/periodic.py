"""Periodic runs of words: every maximal stretch that repeats itself, and the texts with their repeats collapsed.

A run is a stretch of consecutive words with smallest period q whose words q apart are identical, which no neighbouring
word extends, and which is long enough (``min_length`` words and ``min_exponent`` periods). The runs are found by
:mod:`tessera.llm.repeats` (tandem-repeat vocabulary of a suffix tree). Before that, places that lie in no long enough run
are left out: in a run of e periods every three consecutive words occur e - 1 times or more (or ``min_length`` - 2 times,
where one word repeats), so a text is cut at three words that are rarer, and its parts again, while that cuts anything off.
The cut loses no run, and no run is extended by a word that it takes away. What is left of a batch of texts goes into one
tree, each part with an end symbol of its own.

Time and memory are linear in the words left, but for a factor of the logarithm of the longest repeat.
Defined results: null or empty text, or text without a word, has no run and collapses to an empty text; keys may be null
or repeat, each row is read by itself; an empty table gives no row; a very long text is searched whole; columns with
clashing names are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import repeats
from tessera.llm.common import Batches, as_bytes

#: Words that share a suffix tree, unless one part of a text is longer.
TREE_WORDS = 1 << 18
#: Cuts after which the rest is searched as it is.
ROUNDS = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
Rewrite = Callable[[str | None, list[bytes]], list[bytes]]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _stretches(places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive places of one owner."""
    new = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(owner) != 0)))
    return new, np.append(new[1:], len(places)) - 1


def candidates(ids: np.ndarray, starts: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the parts of the texts, which begin at ``starts`` in ids, outside of which no word is in a long enough run."""
    ends = np.append(starts[1:], len(ids))
    times = min(min_exponent - 1, min_length - 2)
    if times < 2 or not len(ids):
        long = ends - starts >= min_length
        return starts[long], ends[long]
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    three = (mixed[:-2] * np.uint64(0xBF58476D1CE4E5B9) ^ mixed[1:-1]) * np.uint64(0x94D049BB133111EB) ^ mixed[2:]
    # a count of hashes never falls below the true one, so what it cuts off is rare indeed
    size = 1 << min(22, max(10, int(8 * len(ids)).bit_length()))
    slot = ((three ^ owner[:-2].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    at = np.flatnonzero((owner[:-2] == owner[2:]) & (np.bincount(slot, minlength=size)[slot] >= times))
    for _ in range(ROUNDS):
        if not len(at):
            break
        first, last = _stretches(at, owner[at])
        part = np.repeat(np.arange(len(first)), last - first + 1)
        long = (last - first + 1 >= min_length - 2)[part]
        _, which, count = np.unique(three[at] ^ part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_inverse=True, return_counts=True)
        keep = long & (count[which] >= times)
        if keep.all():
            break
        at = at[keep]
    if not len(at):
        return at, at
    first, last = _stretches(at, owner[at])
    return at[first], at[last] + 3


def runs_of(texts: list[list[bytes]], min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the long enough runs of the texts, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    first, end = candidates(ids, begin[sizes > 0], min_length, min_exponent)
    found = []
    for chosen in _groups(end - first):
        pieces = []
        for n, k in enumerate(chosen):
            pieces += [ids[first[k] : end[k]], [len(ids) + n]]
        length = end[chosen] - first[chosen] + 1
        offset = np.cumsum(length) - length
        start, size, period = repeats.runs(np.concatenate(pieces))
        enough = size >= np.maximum(min_length, min_exponent * period)
        part = np.searchsorted(offset, start[enough], "right") - 1
        found.append((start[enough] - offset[part] + first[chosen][part], size[enough], period[enough]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, size, period = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(begin, start, "right") - 1  # of texts without words, which begin where the next one does, the last is meant
    return text, start - begin[text], size, period


def _groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the parts whose words share a tree."""
    held, size = [], 0
    for k, n in enumerate(lengths.tolist()):
        if held and size + n > TREE_WORDS:
            yield np.array(held)
            held, size = [], 0
        held.append(k)
        size += n + 1
    if held:
        yield np.array(held)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 6, min_exponent: int = 4, rewrite: Rewrite | None = None) -> DataFrame:
    """key, runs (by start and period) and collapsed: the words that no run repeats after its first period, joined by a space.

    ``rewrite`` changes a text's words before the search, by the text of its key.
    """
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = [t.split() if t else [] for t in as_bytes(b.column(2))]
            if rewrite:
                texts = [rewrite(k, w) for k, w in zip(b.column(1).to_pylist(), texts, strict=True)]
            owner, start, length, period = runs_of(texts, min_length, min_exponent)
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
            collapsed = []
            for n, words in enumerate(texts):
                lo, hi = offsets[n], offsets[n + 1]
                if lo < hi:
                    kept = np.ones(len(words), bool)
                    for s, size, q in zip(start[lo:hi].tolist(), length[lo:hi].tolist(), period[lo:hi].tolist(), strict=True):
                        kept[s + q : s + size] = False
                    words = compress(words, kept.tolist())
                collapsed.append(b" ".join(words))
            fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(struct))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[key, "runs", "collapsed"])

    return docs.select(key, F.col(key).cast("string").alias("_key_text"), text).mapInArrow(run, f"`{key}` {kind}, runs {RUNS}, collapsed string")


def periodic_tail(key: str | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the query: with h the crc32 of the key, a text with h % 10 = 0 gets a periodic tail of its own words. None with a null key."""
    h, n = zlib.crc32(key.encode()) if key is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def strongest(runs: Column) -> Column:
    """The run of an array with the greatest exact length / period; the first of several, null of none."""
    greater = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(greater(a, r), r).otherwise(a))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_runs, the strongest run's start, length, period and exponent_milli, and the SHA-256 of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.withColumn("_best", strongest(F.col("runs")))
    return best.select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        "_best.start",
        "_best.length",
        "_best.period",
        F.floor(F.lit(1000) * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
