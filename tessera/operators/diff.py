"""Line diffs: the fewest changes per pair (the one step without a relational form), hunks by windows, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Of the furthest points of each number of changes, every so many are kept; those between are made again on the way back.
KEPT = 64
NOWHERE = -(1 << 30)
ADD, REMOVE = np.array([1], np.int8), np.array([2], np.int8)
#: Rows of one Arrow batch, unless one pair has more.
BATCH = 1 << 16


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements two arrays share: compared in pieces that double, so the cost follows the result."""
    at, size, n = 0, 64, min(len(x), len(y))
    while at < n:
        differ = x[at : min(at + size, n)] != y[at : min(at + size, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return n


def _further(reach: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The furthest place in x on each diagonal after d changes, from that after d - 1; diagonal -d + 2 i is element i."""
    m, n, d = len(x), len(y), len(reach)
    k = np.arange(-d, d + 1, 2)
    across, down = np.full(d + 1, NOWHERE, np.int64), np.full(d + 1, NOWHERE, np.int64)
    across[1:], down[:-1] = reach + 1, reach
    across[across > m] = NOWHERE
    down[down - k > n] = NOWHERE
    at = np.maximum(across, down)
    open_ = np.flatnonzero((at >= 0) & (at < m) & (at - k < n))
    while len(open_) > 8:
        same = x[at[open_]] == y[at[open_] - k[open_]]
        open_ = open_[same]
        at[open_] += 1
        open_ = open_[(at[open_] < m) & (at[open_] - k[open_] < n)]
    for i in open_.tolist():
        at[i] += _common(x[at[i] :], y[at[i] - k[i] :])
    return at


def _changes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Operations that make x to y, in order: 0 keeps an element, 1 adds one, 2 removes one.

    Elements that only one side has are changes anyway and are left out of the search, which follows the furthest points
    that 0, 1, 2, ... changes of the others reach (time in proportion to the lengths and to the square of those changes,
    not to the product of the lengths). On the way back a kept element comes before any change, and an added one before a
    removed one wherever the elements before it lose nothing that way.
    """
    size = 1 + max(x.max(initial=-1), y.max(initial=-1))
    both = (np.bincount(x, minlength=size) > 0) & (np.bincount(y, minlength=size) > 0)
    in_x, in_y = both[x], both[y]
    u, v = x[in_x], y[in_y]
    reach = np.array([_common(u, v)], np.int64)
    d, kept, goal = 0, [reach], len(u) - len(v)
    while d < abs(goal) or (d - goal) % 2 or reach[(goal + d) // 2] < len(u):
        reach = _further(reach, u, v)
        d += 1
        if d % KEPT == 0:
            kept.append(reach)
    i, j, p, q, out, low, made = len(x), len(y), len(u), len(v), [], -1, []
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            run = _common(x[:i][::-1], y[:j][::-1])
            i, j, p, q = i - run, j - run, p - run, q - run
            out.append(np.zeros(run, np.int8))
            continue
        added = alone = bool(j) and not in_y[j - 1]
        if d and q and not alone:
            if (d - 1) // KEPT != low:
                low = (d - 1) // KEPT
                made = [kept[low]]
                while len(made) < KEPT:
                    made.append(_further(made[-1], u, v))
            k = p - q + 1
            added = k <= d - 1 and made[(d - 1) % KEPT][(k + d - 1) // 2] >= p
        out.append(ADD if added else REMOVE)
        if added:
            j, q, d = (j - 1, q, d) if alone else (j - 1, q - 1, d - 1)
        else:
            i, p, d = (i - 1, p - 1, d - 1) if in_x[i - 1] else (i - 1, p, d)
    return np.concatenate([*out[::-1], np.zeros(0, np.int8)])


def _numbered_ops(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Operations of the diff of two lists of lines, and the old and new line (from 0) of each, -1 where it has none."""
    names: dict[str, int] = {}
    x = np.array([names.setdefault(s, len(names)) for s in a], np.int32)
    y = np.array([names.setdefault(s, len(names)) for s in b], np.int32)
    head = _common(x, y)
    tail = _common(x[head:][::-1], y[head:][::-1])
    ops = np.concatenate([np.zeros(head, np.int8), _changes(x[head : len(x) - tail], y[head : len(y) - tail]), np.zeros(tail, np.int8)])
    old, new = np.where(ops != 1, np.cumsum(ops != 1) - 1, -1), np.where(ops != 2, np.cumsum(ops != 2) - 1, -1)
    return ops, old, new


OPS = ["unchanged", "added", "removed"]


def diff_ops(old: str, new: str) -> list[tuple[str, int | None, int | None, str]]:
    """Operations (op, old line, new line, text) of the line diff; where both directions keep the longest common subsequence, added lines come later."""
    a, b = old.split("\n"), new.split("\n")
    return [(OPS[o], i + 1 if i >= 0 else None, j + 1 if j >= 0 else None, a[i] if i >= 0 else b[j]) for o, i, j in zip(*(v.tolist() for v in _numbered_ops(a, b)), strict=True)]


def line_diff(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """key, seq, op, old_line, new_line, line. A null version counts as empty text. A pair is compared in one task, in time that follows its changes."""
    kind = pairs.schema[key].dataType.simpleString()
    names = pa.array(OPS)

    def batch(keys: pa.Array, held: list[tuple]) -> pa.RecordBatch:
        at = np.repeat([r for r, *_ in held], [len(o) for _, o, *_ in held])
        ops, i, j = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        seq = np.concatenate([np.arange(len(h[1]), dtype=np.int32) for h in held])
        line = [x for h in held for x in h[4]]
        number = lambda v: pa.array(np.maximum(v, 0) + 1, pa.int32(), mask=v < 0)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(seq), names.take(pa.array(ops)), number(i), number(j), pa.array(line, pa.string())], names=[key, "seq", "op", "old_line", "new_line", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            held, size = [], 0
            for r, (o, n) in enumerate(zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True)):
                a, b = (o or "").split("\n"), (n or "").split("\n")
                ops, i, j = _numbered_ops(a, b)
                held.append((r, ops, i, j, [a[p] if p >= 0 else b[q] for p, q in zip(i.tolist(), j.tolist(), strict=True)]))
                size += len(ops)
                if size >= BATCH:
                    yield batch(t.column(0), held)
                    held, size = [], 0
            if held:
                yield batch(t.column(0), held)

    return pairs.select(key, old, new).mapInArrow(run, f"`{key}` {kind}, seq int, op string, old_line int, new_line int, line string")


def hunks(ops: DataFrame, key: str) -> DataFrame:
    """key, hunk, type, old_start, old_end, new_start, new_end, content: runs of changes between unchanged lines.

    A run of removed lines followed by added ones is one modified hunk; content is the new text, or the old where removed.
    """
    w = Window.partitionBy(key).orderBy("seq")
    changed = F.col("op") != "unchanged"
    # a new hunk begins after an unchanged line, or where removals follow additions
    begins = changed & (F.coalesce(F.lag("op").over(w), F.lit("unchanged")) == "unchanged") | ((F.col("op") == "removed") & (F.lag("op").over(w) == "added"))
    g = ops.withColumn("_b", begins.cast("int")).withColumn("hunk", F.sum("_b").over(w)).where(changed)
    t = g.groupBy(key, "hunk").agg(
        F.min("old_line").alias("old_start"), F.max("old_line").alias("old_end"), F.min("new_line").alias("new_start"), F.max("new_line").alias("new_end"),
        F.array_sort(F.collect_list(F.struct("seq", "op", "line"))).alias("_l"),
    )
    kind = F.when(F.col("old_start").isNull(), "added").when(F.col("new_start").isNull(), "removed").otherwise("modified")
    side = F.when(kind == "removed", "removed").otherwise("added")
    content = F.array_join(F.transform(F.filter("_l", lambda x: x["op"] == side), lambda x: x["line"]), "\n")
    return t.select(key, "hunk", kind.alias("type"), "old_start", "old_end", "new_start", "new_end", content.alias("content"))


def diff_stats(h: DataFrame, key: str) -> DataFrame:
    """key, added, removed, modified lines and n_hunks."""
    span = lambda a, b: F.col(b) - F.col(a) + 1
    of = lambda t, a, b: F.coalesce(F.sum(F.when(F.col("type") == t, span(a, b))), F.lit(0)).alias(t)
    return h.groupBy(key).agg(of("added", "new_start", "new_end"), of("removed", "old_start", "old_end"), of("modified", "new_start", "new_end"), F.count("*").alias("n_hunks"))


def summary(added: Column, removed: Column, modified: Column) -> Column:
    """``1 addition, 2 deletions, 1 modification``; ``No changes detected`` for none."""
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, F.lit("")).otherwise("s")))
    text = F.concat_ws(", ", part(added, "addition"), part(removed, "deletion"), part(modified, "modification"))
    return F.when(text == "", "No changes detected").otherwise(text)


def touching(h: DataFrame, targets: list[str]) -> DataFrame:
    """Hunks whose content holds one of the targets."""
    return h.where(F.exists(F.array(*map(F.lit, targets)), lambda t: F.contains(F.col("content"), t))) if targets else h


def contextual(h: DataFrame, new_lines: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Hunks with their content widened by n lines of the new text on both sides. new_lines: key, pos (from 1), line."""
    at = F.when(F.col("new_start").isNotNull(), F.col("new_start")).otherwise(F.col("old_start"))
    to = F.when(F.col("new_end").isNotNull(), F.col("new_end")).otherwise(F.col("old_start") - 1)
    wide = h.withColumn("_pos", F.explode(F.sequence(F.greatest(at - n, F.lit(1)), F.greatest(to + n, F.lit(1)))))
    j = wide.join(new_lines.select(key, F.col("pos").alias("_pos"), "line"), [key, "_pos"])
    t = j.groupBy(key, "hunk", "type", "old_start", "old_end", "new_start", "new_end").agg(F.array_sort(F.collect_list(F.struct("_pos", "line"))).alias("_l"))
    return t.select(key, "hunk", "type", "old_start", "old_end", "new_start", "new_end", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("content"))


def apply_hunks(text: str, changes: list[dict], parity: bool = False) -> str:
    """Text with the hunks, given in order, applied. Added lines go where new_start says; under ``parity`` after all hunks with old lines."""
    lines, out, at = text.split("\n"), [], 1
    if parity:
        changes = sorted(changes, key=lambda c: (c["old_start"] is None, c["old_start"] or 0))
    for c in changes:
        upto = c["old_start"] if c["old_start"] is not None else at if parity else at + max(c["new_start"] - 1 - len(out), 0)
        out += lines[at - 1 : upto - 1]
        at = upto
        if c["type"] != "removed":
            out += c["content"].split("\n")
        if c["old_end"] is not None:
            at = c["old_end"] + 1
    return "\n".join(out + lines[at - 1 :])


def apply_all(texts: DataFrame, h: DataFrame, key: str, text: str = "old") -> DataFrame:
    """key and text: each text with its hunks (as of ``hunks``) applied in order; a text without hunks stays. A row holds one text and its hunks."""
    kind = texts.schema[key].dataType.simpleString()
    fields = ["hunk", "type", "old_start", "old_end", "new_start", "new_end", "content"]
    per = h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_hunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [apply_hunks(x or "", changes or []) for x, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=[key, "text"])

    return texts.select(key, F.col(text).alias("_text")).join(per, key, "left").mapInArrow(run, f"`{key}` {kind}, text string")


def update_text(changes: DataFrame, key: str) -> DataFrame:
    """key and text: ``// REMOVE`` or ``// UPDATE symbol at line n`` with the code, joined by an empty line, in symbol order."""
    verb = F.when(F.col("change") == "removed", "REMOVE").otherwise("UPDATE")
    one = F.concat(F.lit("// "), verb, F.lit(" "), F.col("symbol"), F.lit(" at line "), F.col("line").cast("string"), F.lit("\n"), F.coalesce("new_code", "old_code", F.lit("")))
    return changes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol", one.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
