"""License scans: phrases, and an exact set-similarity join with license templates, in DataFrame operations only.

Base labels: a phrase's words stand consecutively. The method's labels: a block of the text holds at least
``CONTAINMENT`` of a template's distinct words. Blocks are cut from the words of the whole text, whatever its lines, and
overlap by half; a template is compared with blocks of the smallest of ``BLOCKS`` sizes that is twice its own length or
more, so a notice that stands whole in the text stands whole in a block, and a short template is not pieced together
from a long block.

The join is exact: template words are ordered by their frequency over all documents, rarest first; a block that meets
the threshold has one of the template's first |T| - need + 1 words (prefix filter), at least ``need`` template words of
any kind (length filter, first for the whole text), and enough words left after the first common one on both sides
(positional filter). Candidates that pass are verified by their whole intersection.

Templates come from ``licenses.tsv`` (label, words), or are given. Bounded and broadcast: the templates' words, which do
not grow with the documents. Texts are split into words once; the words of those that hold enough words of a template
are written for the join, the others are done.
Defined results: null text is empty and has no word, label or place; repeated rows are scanned each; a null key is
scanned like any other; labels found twice come once and in order, so ties need no rule; an empty table gives no row;
columns with clashing names are never read; a very long text is scanned whole.
"""

from __future__ import annotations

import math
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import settle

BLOCKS, CONTAINMENT = (64, 128, 256), 0.8
# The phrases of the base labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
Templates = tuple[tuple[str, str], ...]


@cache
def templates(path: str = str(Path(__file__).with_name("licenses.tsv"))) -> Templates:
    """(label, words) of each well-known notice."""
    return tuple(tuple(line.split("\t")) for line in Path(path).read_text().splitlines() if line)


@cache
def families(known: Templates, containment: float = CONTAINMENT) -> tuple[tuple[int, int], ...]:
    """Of each template: its family, named by the first in it, and the words of the blocks it is compared with.

    Templates of different labels are of one family where a text that holds one whole holds enough of the other.
    """
    sets, up = [set(t.split()) for _, t in known], list(range(len(known)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if known[i][0] != known[j][0] and len(a & b) >= needed(known[i][1], containment):
                lo, hi = sorted((up[i], up[j]))
                up = [lo if x == hi else x for x in up]
    most = {f: max(len(t.split()) for (_, t), x in zip(known, up, strict=True) if x == f) for f in up}
    return tuple((f, next((b for b in BLOCKS if b >= 2 * most[f]), 2 * most[f])) for f in up)


def vocabulary(known: Templates) -> list[str]:
    return sorted({w for _, t in known for w in t.split()})


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP), lambda w: w != "")


def places(w: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively in the array, from 0."""
    p = phrase.split()
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - len(p), F.lit(0)))
    return F.when(F.size(w) >= len(p), F.filter(at, lambda i: _every([F.get(w, i + k) == x for k, x in enumerate(p)])))


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def needed(template: str, containment: float = CONTAINMENT) -> int:
    return math.ceil(round(containment * len(set(template.split())), 9))


def _ordered(held: DataFrame, known: Templates) -> dict[str, int]:
    """Rank of each template word by the number of documents that hold it, rarest first; ties by the word."""
    got = held.select(F.explode("held").alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in got}
    return {w: i for i, w in enumerate(sorted(vocabulary(known), key=lambda w: (n.get(w, 0), w)))}


def _enough(held: Column, known: Templates, containment: float) -> Column:
    """Length filter of a whole text: it holds as many words of some template as a block must."""
    out = F.lit(False)
    for t in {t for _, t in known}:
        out = out | (F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(set(t.split())))))) >= needed(t, containment))
    return (F.size(held) > 0) & out


def _blocks(ranked: DataFrame, length: int, least: int) -> DataFrame:
    """rid, length and held: the template words of each block of so many words that holds at least so many."""
    half = length // 2
    n_blocks = F.greatest(F.ceil((F.size("r") - length) / half) + 1, F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.array_sort(F.array_distinct(F.array_compact(F.slice("r", i * half + 1, length)))))
    return ranked.select("rid", F.lit(length).alias("length"), F.explode(F.filter(cut, lambda b: F.size(b) >= least)).alias("held"))


def contained(some: DataFrame, rank: dict[str, int], known: Templates, containment: float = CONTAINMENT) -> DataFrame:
    """(rid, w: the words, held: the template words among them) -> rid, label, containment, best: every template that a block of the row holds; best marks those that a block holds most of, among notices that differ in a word or two."""
    spark, rows, kin = some.sparkSession, [], families(known, containment)
    for i, ((label, t), (family, length)) in enumerate(zip(known, kin, strict=True)):
        own = sorted(rank[w] for w in set(t.split()))
        need = needed(t, containment)
        rows += [(i, label, family, length, own, len(own), need, r, k) for k, r in enumerate(own[: len(own) - need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(rows, "template int, label string, family int, length int, own array<int>, n_own int, need int, rank int, k int"))

    ranks = F.create_map(*[F.lit(x) for w in rank for x in (w, rank[w])])
    # written: else the optimiser would move the lookups of all held words into the lambda and make them for every word
    ranked = settle(some.select("rid", "w", "held", F.transform("held", lambda x: F.element_at(ranks, x)).alias("of")))
    ranked = ranked.select("rid", F.transform("w", lambda x: F.get("of", F.array_position("held", x).cast("int") - 1)).alias("r"))  # null: no template word
    parts = [_blocks(ranked, length, min(needed(t, containment) for (_, t), (_, n) in zip(known, kin, strict=True) if n == length)) for length in sorted({n for _, n in kin})]
    held = parts[0]
    for p in parts[1:]:
        held = held.union(p)
    held = held.distinct()  # the same words found once more add nothing
    cand = held.select("rid", "length", "held", F.posexplode("held").alias("j", "rank")).join(prefixes, ["length", "rank"]).where(F.size("held") >= F.col("need"))
    cand = cand.where(1 + F.least(F.col("n_own") - F.col("k") - 1, F.size("held") - F.col("j") - 1) >= F.col("need"))
    both = F.size(F.array_intersect("held", "own"))
    first = F.col("rank") == F.array_min(F.array_intersect("held", "own"))  # a pair that shares several prefix words is one candidate
    found = cand.where(first & (both >= F.col("need"))).select("rid", "length", "held", "family", "label", (both / F.col("n_own")).alias("containment"), "n_own")
    most = F.max(F.struct("containment", "n_own")).over(Window.partitionBy("rid", "length", "held", "family"))
    return found.withColumn("most", most).select("rid", "label", "containment", (F.struct("containment", "n_own") == F.col("most")).alias("best"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, known: Templates | None = None) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and likely_labels, one row per row of docs.

    labels has every template that a block holds enough of; likely_labels, of notices that differ in a word or two, only
    those that a block holds most of. score is the largest share of a template found, 1 where a base phrase stands.
    """
    known = known or templates()
    w = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.struct("key", F.xxhash64("text").alias("x")).alias("rid"), words(F.col("text")).alias("w"))
    places_ = [F.when(F.arrays_overlap("w", F.array(F.lit(p.split()[k]))), places(F.col("w"), p)) for (p, _), k in zip(PHRASES, (2, 0, 0), strict=True)]
    held = F.array_intersect("w", F.array(*map(F.lit, vocabulary(known))))
    base = w.select("rid", "w", held.alias("held"), F.size("w").cast("long").alias("n_words"), *[F.coalesce(h, F.array().cast("array<int>")).alias(f"p{i}") for i, h in enumerate(places_)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    names = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    found = [F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), names.alias("names")]
    done = settle(base.select("rid", "n_words", *found, "held", F.when(_enough(F.col("held"), known, containment), F.col("w")).alias("w")))
    some = done.where("w is not null")
    more = contained(some.select("rid", "w", "held"), _ordered(done, known), known, containment).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"), F.collect_set(F.when(F.col("best"), F.col("label"))).alias("likely"))
    columns = ["rid", "n_words", "n_base", "first_word", "last_word", "names"]
    few = done.where("w is null").select(*columns, F.lit(None).cast("array<string>").alias("more"), F.lit(None).cast("double").alias("most"), F.lit(None).cast("array<string>").alias("likely"))
    out = some.select(*columns).join(more, "rid", "left").unionByName(few)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    with_names = lambda a: joined(F.concat("names", F.coalesce(a, F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return out.select(F.col("rid.key").alias(key), "n_words", "n_base", "first_word", "last_word", joined(F.col("names")).alias("base_labels"), with_names("more").alias("labels"), score.alias("score"), with_names("likely").alias("likely_labels"))


def oracle_sql() -> str:
    """DuckDB SQL: every block of every text against every template of its length, without filters."""
    gap = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
    word = lambda t: f"list_filter(string_split_regex(translate({t}, '{_UPPER}', '{_LOWER}'), '{gap}'), lambda x: x <> '')"
    found = ", ".join(f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: {' and '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))}) p{j}" for j, (p, _) in enumerate(PHRASES))
    names = ", ".join(f"case when len(p{j}) > 0 then '{label}' end" for j, (_, label) in enumerate(PHRASES))
    values = ", ".join(f"('{label}', {family}, {length}, ['{"', '".join(sorted(set(t.split())))}'], {needed(t)})" for (label, t), (family, length) in zip(templates(), families(templates()), strict=True))
    lengths = ", ".join(f"({n})" for n in sorted({n for _, n in families(templates())}))
    every = " || ".join(f"p{j}" for j in range(len(PHRASES)))
    return f"""
with w as (select row_number() over () rid, doc_id, {word("coalesce(text, '')")} w from documents),
b as (select rid, doc_id, len(w) n, {found} from w),
blocks as (select rid, length, i, list_distinct(list_slice(w, i * (length // 2) + 1, i * (length // 2) + length)) w from (select rid, w, length, unnest(range(0, greatest(ceil((len(w) - length) / (length / 2.0))::bigint + 1, 1))) i from w, (values {lengths}) l(length))),
t as (select * from (values {values}) v(label, family, length, own, need)),
o as (select rid, length, i, family, label, len(own) n_own, need, len(list_intersect(w, own)) overlap from blocks join t using (length)),
f as (select rid, label, overlap / n_own::double containment, row(overlap / n_own::double, n_own) own, max(row(overlap / n_own::double, n_own)) over (partition by rid, length, i, family) most from o where overlap >= need),
m as (select rid, list(distinct label) more, max(containment) most, list(distinct label) filter (own = most) likely from f group by rid)
select b.doc_id, b.n::bigint n_words, len({every})::bigint n_base, list_min({every})::bigint first_word, list_max({every})::bigint last_word,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null))), ',') base_labels,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null) || coalesce(more, []))), ',') labels,
  case when len({every}) > 0 then 1.0 else coalesce(most, 0.0) end::double score,
  array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x is not null) || coalesce(likely, []))), ',') likely_labels
from b left join m using (rid)"""
