"""Joins, aggregations and rankings over fact tables of symbols, references, imports and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S

#: Weights of the relations in a coupling, and what the reverse direction adds.
COUPLING = {"inherits": 0.9, "implements": 0.9, "contains": 0.8, "uses": 0.6, "calls": 0.6, "imports": 0.4}
REVERSE = 0.3


def symbol_diff(old: DataFrame, new: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """keys, change (added, removed, modified), old_code, new_code. Empty code counts as absent; equal rows are left out."""
    o = old.select(*keys, F.nullif(F.col(code), F.lit("")).alias("old_code"))
    n = new.select(*keys, F.nullif(F.col(code), F.lit("")).alias("new_code"))
    both = o.join(n, keys, "full_outer").where(~F.col("old_code").eqNullSafe(F.col("new_code")))
    change = F.when(F.col("old_code").isNull(), "added").when(F.col("new_code").isNull(), "removed").otherwise("modified")
    return both.select(*keys, change.alias("change"), "old_code", "new_code")


def minimal_imports(specifiers: DataFrame, used: DataFrame, keep_side_effects: bool = True) -> DataFrame:
    """Specifiers whose local name (alias or name) is used, and statements without specifiers."""
    local = specifiers.withColumn("local", F.coalesce("alias", "name"))
    kept = local.where("local is not null").join(used.select(F.col("symbol").alias("local")).distinct(), "local", "left_semi")
    bare = local.where("local is null")
    return (kept.unionByName(bare) if keep_side_effects else kept).drop("local")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a without a match in b."""
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def distinct_in_order(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """First place of every distinct trimmed value of a group."""
    return df.groupBy(*group, F.trim(value).alias(value)).agg(F.min(order).alias(order))


def suggest_imports(symbols: DataFrame, packages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """symbol, package, confidence of the pairs of names that are similar enough.

    Two names of lengths a and b are similar at edit distance d with d < (1 - threshold) * max(a, b). Each name is cut
    into D + 1 pieces of fixed places and near-equal sizes, D the largest distance that its length allows; an edit touches
    one piece at most, so one piece of the shorter or equal name stands in the longer within D places of its own. Pairs
    meet by an equi-join on (length, piece number, its place, text), so two names meet only where they share a piece, and
    the edit distance is computed for those. Names too short for their distance (D pieces would be empty) meet by length.
    """
    s = symbols.select("symbol", F.lower("symbol").alias("a")).withColumn("la", F.length("a")).where("la > 0")
    p = packages.select("package", F.lower("package").alias("b")).withColumn("lb", F.length("b")).where("lb > 0")
    # the lengths of symbols that a package can match, and the distance allowed for each pair of lengths
    most = lambda n: F.greatest(F.ceil((1 - threshold) * n - 1e-9) - 1, F.lit(0)).cast("int")
    low, high = F.floor(F.col("lb") * threshold) + 1, F.ceil(F.col("lb") / threshold) - 1
    p = p.where(low <= high).withColumn("la", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    p = p.withColumn("d", most(F.greatest("la", "lb"))).where(F.abs(F.col("la") - F.col("lb")) <= F.col("d"))
    sims = lambda df: df.withColumn("confidence", S.name_similarity("a", "b")).where(F.col("confidence") > threshold).select("symbol", "package", "confidence")
    short = p.where("la <= d")
    by_length = s.join(short.select("package", "b", "la"), "la")
    # pieces are of the symbol: piece i of d + 1 begins at la * i / (d + 1); in the package it may stand up to d places off
    long = p.where("la > d")
    edge = lambda i: F.floor(F.col("la") * i / (F.col("d") + 1)).cast("int")
    wanted = long.select("la", "d").distinct()
    pieces = s.join(F.broadcast(wanted), "la").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    pieces = pieces.select("symbol", "a", "la", "d", "i", F.substring(F.col("a"), edge(F.col("i")) + 1, edge(F.col("i") + 1) - edge(F.col("i"))).alias("piece"))
    at = F.explode(F.sequence(F.greatest(edge(F.col("i")) - F.col("d"), F.lit(0)), F.least(edge(F.col("i")) + F.col("d"), F.col("lb"))))
    offered = long.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d")))).withColumn("at", at)
    offered = offered.select("package", "b", "la", "d", "i", F.substring(F.col("b"), F.col("at") + 1, edge(F.col("i") + 1) - edge(F.col("i"))).alias("piece")).distinct()
    by_piece = pieces.join(offered, ["la", "d", "i", "piece"]).select("symbol", "a", "package", "b").distinct()
    return sims(by_length.select("symbol", "a", "package", "b").union(by_piece))


def cross_references(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """definitions (symbol, file, ...; one row per symbol, the last file of several) with usage_count, file_count (files of the definition and the uses) and best_file, n_best: the file with most uses (ties to the smaller)."""
    others = [c for c in definitions.columns if c != "symbol"]
    d = definitions.groupBy("symbol").agg(F.max(F.struct("file", *[c for c in others if c != "file"])).alias("m")).select("symbol", *[F.col(f"m.{c}").alias(c) for c in others])
    per = references.groupBy("symbol", F.col("file").alias("_f")).agg(F.count("*").alias("_n"))
    per = per.join(d.select("symbol", "file"), "symbol")
    uses = per.groupBy("symbol").agg(F.sum("_n").alias("usage_count"), (F.count("*") + 1 - F.max((F.col("_f") == F.col("file")).cast("int"))).alias("file_count"), F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_f").alias("best_file"))).alias("b"))
    u = uses.select("symbol", "usage_count", "file_count", "b.best_file", (-F.col("b.neg")).alias("n_best"))
    return d.join(u, "symbol", "left").withColumns({"usage_count": F.coalesce("usage_count", F.lit(0).cast("long")), "file_count": F.coalesce("file_count", F.lit(1).cast("long"))})


def usage_summary(crossed: DataFrame) -> DataFrame:
    """One row: total_symbols, total_references, mean_references, unused, public_used and cross_file symbols."""
    n = lambda c: F.sum(c.cast("long"))
    return crossed.agg(F.count("*").alias("total_symbols"), F.sum("usage_count").alias("total_references"), F.avg("usage_count").alias("mean_references"), n(F.col("usage_count") == 0).alias("unused"), n(F.col("is_public")).alias("public_api"), n(F.col("file_count") > 1).alias("cross_file"))


def opportunities(crossed: DataFrame, duplicated: Column | None = None) -> DataFrame:
    """symbol, file, type, impact, effort, description: what could be done about a symbol, one row each.

    crossed as of ``cross_references`` with kind, line_count and is_public. Whether a symbol repeats code is not told by the
    tables; ``duplicated`` may say so.
    """
    c, used = F.col, F.col("usage_count")
    rules = [
        ("extract_method", (used > 3) & (duplicated if duplicated is not None else F.lit(False)), "medium", 2.0, "the same code stands in several places and could be one function"),
        ("inline_method", (used == 1) & (c("kind") == "function") & (c("line_count") <= 5), "low", 0.5, "short and called once, so it could stand at the call"),
        ("remove_unused", (used == 0) & ~c("is_public"), "low", 0.25, "nothing refers to it and it is not public"),
        ("move_method", (c("file_count") > 1) & (c("best_file") != c("file")), "medium", 1.5, "another file uses it more than its own"),
        ("rename_symbol", S.confusing(c("name") if "name" in crossed.columns else c("symbol").cast("string")), "low", 1.0, "the name tells too little"),
    ]
    one = lambda t, cond, impact, effort, text: F.when(cond, F.struct(F.lit(t).alias("type"), F.lit(impact).alias("impact"), F.lit(effort).alias("effort"), F.lit(text).alias("description")))
    return crossed.select("symbol", "file", F.explode(F.array_compact(F.array(*[one(*r) for r in rules]))).alias("o")).select("symbol", "file", "o.*")


def ranked_opportunities(found: DataFrame) -> DataFrame:
    """Opportunities by impact (high first) and effort (low first)."""
    order = F.when(F.col("impact") == "high", 3).when(F.col("impact") == "medium", 2).otherwise(1)
    return found.orderBy(F.desc(order), "effort", "symbol", "type")


def hotspots(crossed: DataFrame, change: Column, complexity: Column, least: float = 0.7) -> DataFrame:
    """symbol, file, risk, advice (array) of the symbols whose risk is above ``least``."""
    risk = S.hotspot_risk("usage_count", change, complexity)
    h = crossed.withColumns({"risk": risk, "advice": S.hotspot_advice(F.col("usage_count"), change, complexity, F.col("file_count"))})
    return h.where(F.col("risk") > least).select("symbol", "file", "risk", "advice")


def symbol_dependents(references: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """symbol, dependent: the symbols whose lines hold a use or call of the symbol (references: symbol, file, line, type; spans: file, name, start_line, end_line, pos). Of several spans the first in the file counts."""
    used = references.where(F.col("type").isin("usage", "call")).select("symbol", "file", "line").distinct().withColumn("point_id", F.xxhash64("symbol", "file", "line"))
    inside = containing(used, spans, ["file"], "line", "start_line", "end_line", F.col("pos"), width)
    return inside.where("name is not null").select("symbol", F.col("name").alias("dependent")).distinct()


def parents(relations: DataFrame) -> DataFrame:
    """child, parent of every inheritance or implementation (children of a symbol are the same rows read the other way)."""
    return relations.where(F.col("type").isin("extends", "implements")).select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()


def merged_relations(relations: DataFrame) -> DataFrame:
    """src and its relations over all files, as an array of (type, dst, file) in order. For display: one symbol's relations are one row."""
    return relations.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("type", "dst", "file"))).alias("relations"))


def symbol_info(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """wanted (symbol, file) with the columns of the symbol of that name in that file; null where there is none."""
    return wanted.join(symbols.withColumnRenamed("name", "symbol"), ["symbol", "file"], "left")


def present(codes: DataFrame, names: DataFrame) -> DataFrame:
    """key, symbol: the names (one column ``symbol``) that stand as words in a code (key, code)."""
    word = codes.select("key", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))).alias("symbol"))
    return word.join(names.select("symbol").distinct(), "symbol", "left_semi").select("key", "symbol")


def usage_metrics(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """symbol, usage_count, file_count (of the uses), average over all symbols."""
    uses = references.groupBy("symbol").agg(F.count("*").alias("usage_count"), F.count_distinct("file").alias("file_count"))
    both = definitions.select("symbol").join(uses, "symbol", "left").fillna(0, ["usage_count", "file_count"])
    mean = both.agg(F.avg("usage_count").alias("average_usage"))
    return both.join(F.broadcast(mean))


def top_and_bottom(usage: DataFrame, n: int = 10) -> DataFrame:
    """The n most and the n least used symbols with their rank; sorts by take-ordered, never the whole table."""
    top = usage.orderBy(F.desc("usage_count"), "symbol").limit(n).withColumn("side", F.lit("top"))
    bottom = usage.orderBy("usage_count", "symbol").limit(n).withColumn("side", F.lit("bottom"))
    w = Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col("usage_count")).otherwise(F.col("usage_count")), "symbol")
    return top.unionByName(bottom).withColumn("rank", F.row_number().over(w))


def dead_code(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """symbol, kind, status, confidence: never used (1.0), or used once and not public (0.7)."""
    uses = references.groupBy("symbol").agg(F.count("*").alias("n"))
    d = definitions.join(uses, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "unused").when((F.col("n") == 1) & ~F.col("is_public"), "potential")
    return d.withColumn("status", status).where("status is not null").select("symbol", "kind", "status", F.when(F.col("status") == "unused", 1.0).otherwise(0.7).alias("confidence"))


def move_candidates(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """symbol, file, best_file, n: symbols used most in another file than their own (ties to the smaller file)."""
    per = references.groupBy("symbol", F.col("file").alias("best_file")).agg(F.count("*").alias("n"))
    best = per.groupBy("symbol").agg(F.max(F.struct("n", F.expr("-best_file").alias("neg"), "best_file")).alias("m")).select("symbol", "m.best_file", "m.n")
    return definitions.select("symbol", "file").join(best, "symbol").where("file <> best_file")


def coupling_ca_ce(edges: DataFrame) -> DataFrame:
    """node, ca (in), ce (out), instability = ce / (ca + ce), over distinct neighbours."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("ce"))
    inc = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("ca"))
    return _instability(out, inc)


def relation_counts(relations: DataFrame) -> DataFrame:
    """node, ca, ce, instability over the relations themselves: two relations with one neighbour count twice."""
    out = relations.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    inc = relations.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    return _instability(out, inc)


def _instability(out: DataFrame, inc: DataFrame) -> DataFrame:
    both = out.join(inc, "node", "full_outer").fillna(0, ["ce", "ca"])
    total = F.col("ca") + F.col("ce")
    return both.select("node", "ca", "ce", F.when(total > 0, F.col("ce") / total).otherwise(0.0).alias("instability"))


def pair_coupling(relations: DataFrame, type_: str = "type", weights: dict[str, float] = COUPLING, reverse: float = REVERSE) -> DataFrame:
    """a, b, coupling of each pair with a relation: summed weights, plus what each reverse one adds, at most 1."""
    w = F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col(type_))
    r = relations.where("src <> dst").select("src", "dst", F.coalesce(w, F.lit(0.0)).alias("w"))
    forward = r.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    back = r.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(reverse).alias("w"))
    return forward.union(back).groupBy("a", "b").agg(F.least(F.sum("w"), F.lit(1.0)).alias("coupling"))


def composition_strength(relations: DataFrame, references: DataFrame) -> DataFrame:
    """src, dst, type, strength = base(contains .9, uses .6, calls .4) * min(references / 5, 1.5), at most 1."""
    base = F.element_at(F.create_map(F.lit("contains"), F.lit(0.9), F.lit("uses"), F.lit(0.6), F.lit("calls"), F.lit(0.4)), F.col("type"))
    n = references.groupBy(F.col("symbol").alias("dst")).agg(F.count("*").alias("n"))
    r = relations.where(base.isNotNull()).join(n, "dst", "left")
    return r.select("src", "dst", "type", F.least(base * F.least(F.coalesce("n", F.lit(0)) / 5, F.lit(1.5)), F.lit(1.0)).alias("strength"))


def cluster_quality(edges: DataFrame, member: DataFrame) -> DataFrame:
    """cluster, n, inside, outside, cohesion = inside / (n (n - 1)), coupling = outside / all edges that touch it."""
    size = member.groupBy("cluster").agg(F.count("*").alias("n"))
    m = lambda c: member.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    e = edges.join(m("src"), "src").join(m("dst"), "dst")
    same = F.col("src_cluster") == F.col("dst_cluster")
    touch = e.select(F.explode(F.array_distinct(F.array("src_cluster", "dst_cluster"))).alias("cluster"), same.cast("long").alias("inside"), (~same).cast("long").alias("outside"))
    t = size.join(touch.groupBy("cluster").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")), "cluster", "left").fillna(0)
    return t.select("cluster", "n", "inside", "outside", F.when(F.col("n") > 1, F.col("inside") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("cohesion"), F.when(F.col("inside") + F.col("outside") > 0, F.col("outside") / (F.col("inside") + F.col("outside"))).otherwise(0.0).alias("coupling"))


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, best: Column, width: int, point_id: str = "point_id") -> DataFrame:
    """points with the interval of the same keys that contains them and is best (smallest ``best``); null where none does.

    Intervals are sent to the cells of ``width`` they overlap, so the range join is an equi-join on (keys, cell).
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    i = intervals.withColumn("_best", best).withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    p = points.select(point_id, *keys, F.col(at).alias("_at")).withColumn("_cell", cell("_at"))
    hit = p.join(i, [*keys, "_cell"]).where((F.col("_at") >= F.col(start)) & (F.col("_at") <= F.col(end)))
    rest = [c for c in intervals.columns if c not in keys]
    first = hit.groupBy(point_id).agg(F.min(F.struct("_best", *rest)).alias("m")).select(point_id, *[F.col(f"m.{c}").alias(c) for c in rest])
    return points.join(first, point_id, "left")


def symbol_search(symbols: DataFrame, term: str, relations: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Symbols by score and reasons: exact name 100, part of the name 50; 20 for a function or class where the query names its kind; 10 for each relation (key, dst) whose target holds the query. Ties to the smaller key."""
    low, query = F.lower("name"), term.lower()
    name = F.when(low == query, 100).when(low.contains(query), 50).otherwise(0)
    named = [k for k in ("function", "class") if k in query]
    kind = F.when(F.col("kind").isin(named), 20).otherwise(0) if named else F.lit(0)
    s = symbols.withColumn("_n", F.lit(0))
    if relations is not None:
        hit = relations.where(F.lower(F.col("dst").cast("string")).contains(query)).groupBy("key").agg(F.count("*").alias("_n"))
        s = symbols.join(hit, "key", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    reason = F.concat_ws(", ", F.when(name == 100, "exact name match").when(name == 50, "partial name match"), F.when(kind > 0, "type match"), F.when(F.col("_n") > 0, F.concat(F.lit("related to "), F.col("_n").cast("string"))))
    s = s.withColumn("score", (name + kind + 10 * F.col("_n")).cast("long")).withColumn("reason", reason).drop("_n")
    return s.where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def relevance_search(scored: DataFrame, threshold: float = 0.1, limit: int = 20) -> DataFrame:
    """Rows above the threshold, boosted by context (same file 0.1, recent 0.15, at most 1), best first; ties to the smaller key."""
    boost = F.least(F.col("score") + F.when(F.col("same_file"), 0.1).otherwise(0.0) + F.when(F.col("recent"), 0.15).otherwise(0.0), F.lit(1.0))
    return scored.where(F.col("score") > threshold).withColumn("boosted", boost).orderBy(F.desc("boosted"), "key").limit(limit)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def macro_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, precision, recall, f1: sums over the classes divided by the number of classes that are predicted at least once; f1 is of the two means."""
    c = confusion(df, actual, predicted)
    p = c.groupBy(F.col(predicted).alias("c")).agg(F.sum("n").alias("said"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    a = c.groupBy(F.col(actual).alias("c")).agg(F.sum("n").alias("there"))
    m = p.join(a, "c", "full_outer").fillna(0, ["said", "hit", "there"])
    part = lambda n: F.sum(F.when(F.col(n) > 0, F.col("hit") / F.col(n)).otherwise(0.0)) / F.sum((F.col("said") > 0).cast("int"))
    t = m.agg((F.sum("hit") / F.sum("said")).alias("accuracy"), part("said").alias("precision"), part("there").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return t.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def ranking_scores(df: DataFrame, group: str, relevant: str, score: str, key: str, k: int = 10) -> DataFrame:
    """mrr and ndcg at k over the groups; ties in the score to the smaller key."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    ideal = Window.partitionBy(group).orderBy(F.desc(relevant), key)
    r = df.withColumn("_r", F.row_number().over(w)).withColumn("_i", F.row_number().over(ideal))
    gain = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col(relevant) / F.log2(F.col(rank) + 1)).otherwise(0.0))
    g = r.groupBy(group).agg(F.min(F.when(F.col(relevant) > 0, F.col("_r"))).alias("first"), gain("_r").alias("dcg"), gain("_i").alias("best"))
    return g.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)).alias("ndcg"))
