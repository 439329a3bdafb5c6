"""Benchmark decontamination by template windows, in DataFrame operations only.

Numbers, units and names become typed placeholders; windows of ``WINDOW`` canonical tokens of every document are
hash-joined with those of the benchmark. A document holds an item where the windows found cover ``coverage`` of the
item's. Where an item has slots, the windows found are aligned (document position less item position). A window with
the item's own slot values always counts; of an alignment's other windows those count whose numbers and names the
document replaces by the same ones throughout (units are left out of this, and two values may get the same one). So a
question asked again with other numbers is found, and so is a copy with a number changed here and there; a text that has
different numbers where the item repeats one is not found by the windows that hold them.

Every window of an item counts. One with more placeholders than words says little by its words (a row of numbers fits
any other), so it is found by its own values only. An item's first word may be read as a name in the middle of a
document's sentence: its first window is looked for both ways.

The benchmark's windows are broadcast when their number is at most ``BROADCAST_WINDOWS`` (checked by a count, 24 bytes
each); beyond that the join shuffles.

Defined results: null or empty text and items without a token match nothing; a null key takes no part; an item shorter
than a window is one window as long as itself; repeated rows of an item count once (the smallest text of an item that
has several); of a repeated document key the rows count together; equal pairs come once; an empty table on either side
gives no row; columns with clashing names are never read; a very long text is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle

WINDOW, COVERAGE = 8, 0.5
BROADCAST_WINDOWS = 1_000_000
# Units of measure that may follow a number.
UNITS = "%|km|m|cm|mm|kg|g|mg|lb|lbs|oz|l|ml|h|s|ms|min|mph|kmh|kph|mi|ft|in|yd|hz|khz|mhz|ghz|kb|mb|gb|tb|kw|kwh|w|v|a|usd|eur|gbp|dollars?|euros?|pounds?|cents?|miles?|meters?|metres?|kilometers?|kilometres?|grams?|kilograms?|liters?|litres?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|degrees?|percent|feet|inches|yards"
# Private-use characters mark the placeholders; VALUE stands before the value that a placeholder replaced.
NUMBER, NAME, UNIT, VALUE = "", "", "", ""
_NUMBER = rf"(?<![\p{{L}}\p{{N}}])(\p{{Nd}}+(?:[.,]\p{{Nd}}+)*)(?:[ \t]?({UNITS})(?![\p{{L}}\p{{N}}]))?"
_NAME = r"(?<=[\p{Ll}\p{Nd},;] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
_BREAK = rf"(?:[^\p{{L}}\p{{N}}\p{{M}}{NUMBER}{NAME}{UNIT}{VALUE}.,]|(?<!\p{{Nd}})[.,]|[.,](?!\p{{Nd}}))+"


def tokens(text: Column, values: bool = False) -> Column:
    """Canonical tokens; with ``values`` each placeholder is followed by VALUE and what it replaced."""
    n, a, u = (f" {NUMBER}{VALUE}$1 {UNIT}{VALUE}$2 ", f" {NAME}{VALUE}$1 ", "") if values else (f" {NUMBER} {UNIT} ", f" {NAME} ", "")
    named = F.regexp_replace(text, _NAME, a)
    return F.filter(F.split(F.lower(F.regexp_replace(named, _NUMBER, n)), _BREAK), lambda x: x != "")


def _canonical(tok: Column) -> Column:
    return F.transform(tok, lambda x: F.substring_index(x, VALUE, 1))


def _hashes(tok: Column, length: int) -> Column:
    """Hash of each window of so many tokens; none where there are fewer."""
    last = F.size(tok) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(length), F.slice(tok, i + 1, length))))


def _slots(raw: Column) -> Column:
    return F.filter(raw, lambda x: x.contains(VALUE))


def _full(length: Column, tok: Column, raw: Column) -> Column:
    """What a window must equal to be found: its canonical tokens, or its own values where it has more placeholders than words."""
    plain = F.size(F.filter(tok, lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    return F.when(2 * plain >= length, F.xxhash64(length, tok)).otherwise(F.xxhash64(length, raw, F.lit("values")))


def item_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, wid (the window's number), pos, length, h (its canonical tokens), full, heavy, slots, n_windows and has_slots.

    Windows that are equal in ``full`` have one number; the first window has a second row where its first word can be read as a name.
    """
    t = items.where(F.col(item).isNotNull()).groupBy(item).agg(F.min(text).alias("text"))
    first = F.regexp_extract("text", r"^[^\p{L}\p{N}]*(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", 1)
    t = t.select(F.col(item).alias("item"), tokens(F.col("text"), values=True).alias("raw"), F.lower(first).alias("first"))
    t = t.where(F.size("raw") > 0).withColumn("length", F.least(F.size("raw"), F.lit(WINDOW)))
    named = F.concat(F.array(F.concat(F.lit(NAME + VALUE), "first")), F.slice("raw", 2, F.col("length") - 1))
    window = lambda raw, pos, own: F.struct(pos.alias("pos"), own.alias("own"), raw.alias("raw"))
    every = F.transform(F.sequence(F.lit(0), F.size("raw") - F.col("length")), lambda i: window(F.slice("raw", i + 1, F.col("length")), i, F.lit(True)))
    other = F.when((F.col("first") != "") & (F.get("raw", F.lit(0)) == F.col("first")), F.array(window(named, F.lit(0), F.lit(False)))).otherwise(F.array().cast("array<struct<pos:int,own:boolean,raw:array<string>>>"))
    w = t.select("item", "length", F.explode(F.concat(every, other)).alias("w")).select("item", "length", "w.pos", "w.own", "w.raw")
    w = w.withColumn("tok", _canonical(F.col("raw"))).withColumn("h", F.xxhash64("length", "tok")).withColumn("full", _full(F.col("length"), F.col("tok"), F.col("raw")))
    w = w.withColumn("slots", _slots(F.col("raw"))).select("item", "pos", "own", "length", "h", "full", (F.col("full") != F.col("h")).alias("heavy"), "slots")
    same = w.where("own").groupBy("item", "full").agg(F.min("pos").alias("wid"))
    n = same.groupBy("item").agg(F.count("*").alias("n_windows"))
    has = w.where("own").groupBy("item").agg(F.max(F.size("slots") > 0).alias("has_slots"))
    own = w.where("own").join(same, ["item", "full"])
    return own.unionByName(w.where("not own").withColumn("wid", F.lit(0))).drop("own").join(n, "item").join(has, "item")


def _placed(t: DataFrame, k: int) -> DataFrame:
    """key, at, full and other (slot values) of each window of k tokens."""
    window = lambda i: F.struct(F.slice("tok", i + 1, k).alias("tok"), F.slice("raw", i + 1, k).alias("raw"))
    w = t.where(F.size("tok") >= k).select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("tok") - k), window)).alias("at", "w"))
    return w.select("key", "at", _full(F.lit(k), F.col("w.tok"), F.col("w.raw")).alias("full"), _slots(F.col("w.raw")).alias("other"))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """key, item, n_windows (of the item), n_found, coverage and exact (every window met in the document stands there with the item's own values), one row per pair found."""
    index = settle(item_windows(items, item, item_text))
    n, lengths = index.count(), [r.length for r in index.select("length").distinct().collect()]
    small = F.broadcast if n <= broadcast_windows else (lambda df: df)
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    windows = lambda tok: F.concat(F.array().cast("array<bigint>"), *[F.coalesce(_hashes(tok, k), F.array().cast("array<bigint>")) for k in sorted(lengths)])
    # tok is a column of its own, used more than once: an expression inside the lambda would be evaluated per window
    flat = docs.select("key", tokens(F.col("text")).alias("tok")).select("key", F.explode(windows(F.col("tok"))).alias("h"))
    hashes = index.select("h").distinct()
    hit = flat.join(small(hashes), "h", "left_semi").distinct()
    # an upper bound for items with slots: windows that differ in their values alone have one canonical hash
    worth = index.select("h", "item", "wid", "n_windows", "has_slots").distinct()
    pairs = hit.join(worth, "h").groupBy("key", "item", "n_windows", "has_slots").agg(F.count_distinct("wid").alias("n_found")).where(F.col("n_found") >= coverage * F.col("n_windows"))
    pairs = settle(pairs)
    plain = pairs.where(~F.col("has_slots")).select("key", "item", "n_windows", "n_found", F.lit(True).alias("exact"))

    slotted = pairs.where("has_slots").select("key", "item", "n_windows")
    if not slotted.isEmpty():
        t = docs.join(slotted.select("key").distinct(), "key", "left_semi").select("key", tokens(F.col("text"), values=True).alias("raw"))
        t = t.select("key", "raw", _canonical(F.col("raw")).alias("tok"))
        placed = _placed(t, lengths[0])
        for k in lengths[1:]:
            placed = placed.union(_placed(t, k))
        known = index.where("has_slots").select("full", "item", "wid", "pos", "slots", "heavy")
        placed = placed.join(small(known), "full").join(slotted, ["key", "item"])
        placed = placed.withColumn("equal", F.col("heavy") | (F.col("slots") == F.col("other")))
        # windows with the item's own values need no alignment: one row of each is enough, however often the document repeats it
        met = placed.groupBy("key", "item", "n_windows", "wid").agg(F.max("equal").alias("equal"))
        aligned = placed.where("not heavy").withColumn("shift", F.col("at") - F.col("pos"))
        where = ["key", "item", "shift"]
        slot, moved = F.col("s.slots"), F.when(~F.col("equal"), F.col("s.other"))
        values = aligned.select(*where, "equal", F.explode(F.arrays_zip("slots", "other")).alias("s")).groupBy(*where, slot.alias("slot")).agg(F.count_distinct(moved).alias("n"))
        split = values.where((F.col("n") > 1) & ~F.col("slot").startswith(UNIT)).groupBy(*where).agg(F.collect_list("slot").alias("split"))
        other = aligned.where("not equal").join(split, where, "left").where("split is null or not arrays_overlap(slots, split)")
        kept = met.where("equal").select("key", "item", "n_windows", "wid").union(other.select("key", "item", "n_windows", "wid")).distinct()
        exact = met.groupBy("key", "item").agg(F.min("equal").alias("exact"))
        again = kept.groupBy("key", "item", "n_windows").agg(F.count("*").alias("n_found")).where(F.col("n_found") >= coverage * F.col("n_windows")).join(exact, ["key", "item"])
        plain = plain.union(again.select("key", "item", "n_windows", "n_found", "exact"))
    return plain.select(F.col("key").alias(key), F.col("item").alias(item), "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("coverage"), "exact")
