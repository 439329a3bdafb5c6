"""Packing token sequences into windows by minimum bin slack.

A document is its token ids and an end id. Every whole window of a document is a sequence of its own; what is left over is
shorter than a window, so all leftovers together are a count for each length. From these counts the windows are planned:
each takes the greatest length left and, by a subset-sum program over bits, the multiset of other lengths that comes
closest to the window; the copies of each length are traced back, and the same window is used as often as the counts
allow. Where nothing fits exactly, the gap is filled by cutting one more leftover, whose rest goes back into the counts.
The last tokens, fewer than a window, are cut into sequences whose lengths are powers of two. So no sequence needs padding.

The plan depends on the counts alone, at most one for each length: its size does not grow with the documents. Leftovers of
one length are numbered through (within a task as they come, between tasks by sums over tasks), and the plan says what
becomes of a range of numbers, so no length is ever gathered in one task.

Bounded: the driver holds the counts and the plan. The sums over tasks are broadcast up to ``BROADCAST_ROWS`` of them and
joined by shuffling beyond. A document's ids pass through one task.
Defined results: null and empty text is the end id alone; keys may be null or repeat, each row is packed by itself; an
empty table gives no row; very long texts are encoded whole; columns with clashing names are never read; which of the
documents with equally long leftovers shares a window with which others depends on their order in the table.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict, deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Batches, as_bytes, settle

WINDOW = 2048
END = 1
#: Sums over tasks are broadcast up to so many rows (24 bytes each).
BROADCAST_ROWS = 1_000_000


# How the word tokenizer normalises and splits a text.
NORMALISED = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same split, for lower-case characters below U+0530 that are no marks and no numbers but 0 to 9, and line ends.
PLAIN = re.compile(r"[^\W\d_]+|\n|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
#: What that split is not meant for: characters above, other spaces and numbers, controls, marks, unassigned ones, the letter with two lower-case forms, special tokens.
ODD = re.compile("[^\t-\r -\x7e\xa1-\xac\xae-\u0377\u037a-\u037f\u0384-\u038a\u038c\u038e-\u03a1\u03a3-\u052f]|[²³¹¼½¾Σ\u0300-\u036f\u0483-\u0489]|<\\|")
#: Pieces of texts, and their parts, whose ids a worker remembers.
PIECES, PARTS = 400_000, 1_000_000
#: Bytes of texts that are split at once, a longer text alone.
GROUP = 4 << 20


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else one from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


class Encoder(dict):
    """Ids of texts, as bytes. It remembers the ids of what stands between white space.

    The word tokenizer drops white space and joins nothing across it, so a text's ids are those of its pieces. New pieces of
    plain characters are lower-cased and split here, all at once, and their parts go to the tokenizer's merges alone, each
    once; other pieces go through the whole tokenizer. With another kind of tokenizer every whole text does.
    """

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.merges = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        spec = json.loads(content)
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_words = normal == NORMALISED and splits[:1] == [SPLIT] and len(splits) == 2
        self.letters, self.parts = _byte_letters(), {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _part(self, part: str) -> bytes:
        name = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        self.parts[part] = ids = self._bytes([t.id for t in self.merges.tokenize(name)])
        return ids

    def _learn(self, pieces: list[bytes]) -> None:
        if not pieces:
            return
        text = b"\n".join(pieces).decode()
        low = text.lower()
        if ODD.search(text) or ODD.search(low) or not unicodedata.is_normalized("NFC", text):
            if len(pieces) == 1:
                self[pieces[0]] = self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
                return
            self._learn(pieces[: len(pieces) // 2])
            self._learn(pieces[len(pieces) // 2 :])
            return
        known, at, found = self.parts, 0, []
        for part in PLAIN.findall(low):
            if part == "\n":
                self[pieces[at]] = b"".join(found)
                at, found = at + 1, []
            else:
                found.append(known.get(part) or self._part(part))
        self[pieces[at]] = b"".join(found)

    def encode(self, texts: list[bytes | None], end: int) -> list[bytes]:
        last = self._bytes([end])
        if not self.by_words:
            return [self._bytes(e.ids) + last for e in self.tokenizer.encode_batch([(t or b"").decode() for t in texts], add_special_tokens=False)]
        out, held, size = [], [], 0

        def settle() -> None:
            self._learn([p for p in set().union(*held) if p not in self])
            out.extend([b"".join([*map(self.__getitem__, pieces), last]) for pieces in held])
            if len(self) > PIECES:
                self.clear()
            if len(self.parts) > PARTS:
                self.parts.clear()

        for t in texts:
            held.append(t.split() if t else [])
            size += len(t or b"")
            if size > GROUP:
                settle()
                held, size = [], 0
        settle()
        return out


@lru_cache(1)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """Copies of each length in the best window: the greatest length, and others whose sum comes closest to the rest.

    Bit t of ``reach`` says whether some of the lengths so far sum to t. Lengths come in falling order, their copies in
    powers of two; what was reachable before each step is kept to trace the copies back.
    """
    seed = max(counts)
    room = window - seed
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length] - (length == seed), room // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left, copies = left - copies, copies * 2
        if reach >> room & 1:
            break
    out, at = defaultdict(int, {seed: 1}), reach.bit_length() - 1
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            out[length] += copies
    return dict(out)


@dataclass(frozen=True)
class Plan:
    """What becomes of the leftovers of each class (their whole length), numbered from 0 on.

    A row holds for the numbers from lo on (to the next row's): their piece that begins at ``base`` of the leftover, of the
    given length. The number lo + t is the copy (t + skip) % copies of the window first + (t + skip) // copies and lies at
    offset + copy * length there.
    """

    window: int
    bits: int
    key: np.ndarray
    lo: np.ndarray
    length: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    copies: np.ndarray
    skip: np.ndarray
    n_sequences: int

    def place(self, kind: np.ndarray, number: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, length) of the pieces that begin at ``base`` of the leftovers."""
        at = np.searchsorted(self.key, ((kind * self.window + base) << self.bits) + number, "right") - 1
        t = number - self.lo[at] + self.skip[at]
        return self.first[at] + t // self.copies[at], self.offset[at] + t % self.copies[at] * self.length[at], self.length[at]


def plan(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """The windows of all leftovers, from how many there are of each length (1 to window - 1)."""
    left = {k: n for k, n in counts.items() if n}
    ranges = {k: deque([(k, 0, 0, n)]) for k, n in left.items()}  # by length: class, base, numbers from lo to hi
    bits = 62 - 2 * window.bit_length()
    if max(left.values(), default=0) >= 1 << bits:
        raise ValueError(f"more than {1 << bits} documents with leftovers of one length")
    rows, n_sequences = [], 0

    def take(length: int, n: int, size: int, first: int, offset: int, copies: int) -> None:
        """n leftovers of a length: their first ``size`` tokens go to the windows from ``first`` on, the rest back."""
        skip = 0
        while skip < n:
            kind, base, lo, hi = ranges[length].popleft()
            cut = min(hi, lo + n - skip)
            if cut < hi:
                ranges[length].appendleft((kind, base, cut, hi))
            rows.append(((kind * window + base << bits) + lo, lo, size, first, offset, copies, skip))
            if size < length:
                ranges.setdefault(length - size, deque()).append((kind, base + size, lo, cut))
                left[length - size] = left.get(length - size, 0) + cut - lo
            skip += cut - lo
        left[length] -= n
        if not left[length]:
            del left[length]

    while left:
        use = fill(left, window)
        gap = window - sum(k * n for k, n in use.items())
        spare = max((k for k, n in left.items() if n > use.get(k, 0)), default=0) if gap else 0
        if gap and not spare:
            break
        times = min(left[k] // (use.get(k, 0) + (k == spare)) for k in {*use, *([spare] if spare else [])})
        offset = 0
        for k in sorted(use, reverse=True):
            take(k, times * use[k], k, n_sequences, offset, use[k])
            offset += k * use[k]
        if spare:
            take(spare, times, gap, n_sequences, offset, 1)
        n_sequences += times
    rest = sum(k * n for k, n in left.items())
    for bit in range(rest.bit_length() - 1, -1, -1):
        room = rest & 1 << bit
        offset = 0
        while offset < room:
            k = max(left)
            size = min(k, room - offset)
            take(k, 1, size, n_sequences, offset, 1)
            offset += size
        n_sequences += room > 0
    cols = np.array(sorted(rows), np.int64).reshape(-1, 7).T
    return Plan(window, bits, *cols, n_sequences)


def encoded(docs: DataFrame, tokenizer: str, key: str, text: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """key, ids, n_tokens, and where the row stands: its task, its number there among leftovers of its length, and the whole windows before it there."""
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        enc, part = _encoder(content.value), TaskContext.get().partitionId()
        seen, whole = np.zeros(window, np.int64), 0
        for b in batches:
            ids = enc.encode(as_bytes(b.column(1)), end)
            n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            rest, full = n % window, n // window
            order = np.argsort(rest, kind="stable")
            begin = np.searchsorted(rest[order], rest[order])
            at = np.empty(len(n), np.int64)
            at[order] = seen[rest[order]] + np.arange(len(n)) - begin
            seen += np.bincount(rest, minlength=window)
            before = whole + np.cumsum(full) - full
            whole += int(full.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, rest, at, before)), pa.array([part] * len(n), pa.int32())], names=[key, "ids", "n_tokens", "rest", "at", "whole_before", "part"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary, n_tokens long, rest long, at long, whole_before long, part int")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; with_ids: also its ids, as an array."""
    rows = settle(encoded(docs, tokenizer, key, text, window, end))
    counts = rows.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n"))
    counts = settle(counts.unionByName(rows.groupBy("part").agg(F.sum(F.expr(f"n_tokens div {window}")).alias("n")).withColumn("rest", F.lit(0).cast("long"))))
    total = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    total.pop(0, 0)
    made = plan(total, window)
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = settle(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    small = F.broadcast if first.count() <= BROADCAST_ROWS else lambda df: df
    whole = first.where("rest = 0").select("part", F.col("first").alias("whole_first"))
    placed = rows.join(small(first.where("rest > 0")), ["part", "rest"], "left").join(small(whole), "part", "left")
    placed = placed.select(key, "ids", "n_tokens", "rest", (F.col("at") + F.coalesce("first", F.lit(0))).alias("number"), (F.col("whole_before") + F.coalesce("whole_first", F.lit(0))).alias("whole"))
    shared = docs.sparkSession.sparkContext.broadcast(made)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        made = shared.value
        for b in batches:
            n, rest, number, whole = (b.column(k).to_numpy() for k in range(2, 6))
            full = n // window
            owner = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
            found = [(owner, nth * window, np.full(len(owner), window), made.n_sequences + whole[owner] + nth, np.zeros(len(owner), np.int64))]
            open_, base = np.flatnonzero(rest), np.zeros(len(n), np.int64)
            while len(open_):
                sequence, offset, length = made.place(rest[open_], number[open_], base[open_])
                found.append((open_, full[open_] * window + base[open_], length, sequence, offset))
                base[open_] += length
                open_ = open_[base[open_] < rest[open_]]
            owner, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, owner))
            owner, start, length, sequence, offset = (x[order] for x in (owner, start, length, sequence, offset))
            ids, crc, parts, held, wide = b.column(1), [], [], -1, b""
            for o, s, size in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True):
                if o != held:
                    raw = ids[o].as_py()
                    held, wide = o, np.frombuffer(raw, np.dtype(f"<u{len(raw) // int(n[o])}")).astype("<u4").tobytes()
                piece = wide[4 * s : 4 * (s + size)]
                crc.append(zlib.crc32(piece))
                if with_ids:
                    parts.append(piece)
            cols = [b.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[owner], sequence, offset))]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                values = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(values, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return placed.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of the packed sequences: pieces with ids, in the order of their offsets. A sequence has at most a window of ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
