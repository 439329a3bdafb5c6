"""The dependency graph of files: edges from imports, strengths, metrics, impact of a change, refactoring candidates, transitive imports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import graph, relational
from tessera.sources import facts

Settle = Callable[[DataFrame], DataFrame]


def file_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_path, symbols and exports (distinct names of each) of every file."""
    n = symbols.groupBy("file_path").agg(F.count_distinct("name").alias("symbols"), F.count_distinct(F.when(F.col("exported"), F.col("name"))).alias("exports"))
    return files.select("file_path").distinct().join(n, "file_path", "left").fillna(0, ["symbols", "exports"])


def file_edges(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst, n_symbols, strength: each relative import of a file that resolves to another file of the graph.

    n_symbols: names that the importing file has and the other exports; strength: their share of the exports, at most 1.
    """
    wanted = imports.select("file_path", "source").distinct()
    e = facts.resolve_imports(wanted, files, facts.GRAPH_CANDIDATES).where("target_path is not null").select(F.col("file_path").alias("src"), F.col("target_path").alias("dst")).distinct()
    exports = symbols.where("exported").select(F.col("file_path").alias("dst"), "name").distinct()
    own = symbols.select(F.col("file_path").alias("src"), "name").distinct()
    shared = e.join(exports, "dst").join(own, ["src", "name"]).groupBy("src", "dst").agg(F.count("*").alias("n_symbols"))
    total = exports.groupBy("dst").agg(F.count("*").alias("_n"))
    j = e.join(shared, ["src", "dst"], "left").join(total, "dst", "left")
    n = F.coalesce("n_symbols", F.lit(0))
    return j.select("src", "dst", n.cast("long").alias("n_symbols"), F.when((n > 0) & (F.col("_n") > 0), F.least(n / F.col("_n"), F.lit(1.0))).otherwise(0.0).alias("strength"))


def file_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_path, symbols, exports, dependencies, dependents, instability of every file."""
    c = relational.relation_counts(edges).select(F.col("node").alias("file_path"), F.col("ce").alias("dependencies"), F.col("ca").alias("dependents"), "instability")
    return nodes.join(c, "file_path", "left").fillna(0)


def file_metrics(nodes: DataFrame, edges: DataFrame, settle: Settle) -> DataFrame:
    """One row: files, dependencies, their mean per file, the longest chain, files on a cycle, mean instability.

    The longest chain counts a cycle as one file.
    """
    coupling = file_coupling(nodes, edges)
    strong = settle(graph.strong_components(edges, settle))
    at = lambda c: strong.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    flat = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).where("src <> dst")
    depth = graph.longest_path(flat, settle).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    on_cycle = strong.agg(F.count("*").alias("files_on_cycles"))
    total = coupling.agg(F.count("*").alias("files"), F.sum("dependencies").alias("dependencies"), F.avg("dependencies").alias("mean_dependencies"), F.avg("instability").alias("mean_instability"))
    return total.join(F.broadcast(depth)).join(F.broadcast(on_cycle))


def change_impact(nodes: DataFrame, edges: DataFrame, changed: DataFrame, settle: Settle) -> DataFrame:
    """file_path, direct, indirect, tests, risk, effort of each changed file: files that depend on it, tests that depend on any of those, and what the change takes."""
    seeds = changed.select(F.col("file_path").alias("src")).distinct()
    back = settle(graph.closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), settle, seeds=seeds).where("src <> dst"))
    n = back.groupBy(F.col("src").alias("file_path")).agg(F.sum((F.col("depth") == 1).cast("long")).alias("direct"), F.sum((F.col("depth") > 1).cast("long")).alias("indirect"))
    tests = affected_tests(edges, back, seeds).groupBy("file_path").agg(F.count("*").alias("tests"))
    j = changed.select("file_path").distinct().join(nodes, "file_path").join(n, "file_path", "left").join(tests, "file_path", "left").fillna(0, ["direct", "indirect", "tests"])
    total = F.col("direct") + F.col("indirect")
    return j.select("file_path", "direct", "indirect", "tests", S.impact_risk(total, F.col("symbols"), F.col("direct")).alias("risk"), S.impact_effort(total, F.col("symbols")).alias("effort"))


def affected_tests(edges: DataFrame, back: DataFrame, seeds: DataFrame) -> DataFrame:
    """file_path (changed), test: test files that depend on the changed file or on a file that depends on it (back: src changed, dst dependent)."""
    reach = seeds.select("src", F.col("src").alias("dst")).union(back.select("src", "dst"))
    tests = edges.where(S.is_test_path("src")).select(F.col("src").alias("test"), "dst").distinct()
    return reach.join(tests, "dst").select(F.col("src").alias("file_path"), "test").distinct()


def refactoring_candidates(nodes: DataFrame, edges: DataFrame, settle: Settle) -> DataFrame:
    """file_path, issues (array), priority, dependencies, dependents, instability, complexity of the files with an issue."""
    cyclic = graph.strong_components(edges, settle).select(F.col("node").alias("file_path"), F.lit(True).alias("cyclic"))
    c = file_coupling(nodes, edges).join(cyclic, "file_path", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    say = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    d, i, n = F.col("dependencies"), F.col("instability"), F.col("symbols")
    issues = F.array_compact(F.array(
        say(d > 10, "High dependency count: ", d), say(F.col("dependents") > 15, "Too many dependents: ", F.col("dependents")), say(i > 0.8, "High instability: ", F.format_number(i, 2)),
        say(n > 50, "Large file: ", n, " symbols"), say(F.col("cyclic"), "Part of circular dependency"),
    ))
    f = c.withColumn("issues", issues).where(F.size("issues") > 0)
    priority = F.when((F.size("issues") >= 3) | F.col("cyclic"), "high").when(F.size("issues") >= 2, "medium").otherwise("low")
    return f.select("file_path", "issues", priority.alias("priority"), "dependencies", "dependents", "instability", (n / 10).alias("complexity"))


def transitive_imports(imports: DataFrame, files: DataFrame, used: DataFrame, settle: Settle, max_rounds: int = 200) -> DataFrame:
    """file_path, source: the relative imports met from a file when only imports of names in use are followed.

    imports as of ``facts.scan_imports``, used (file_path, symbol). Every visited file shows all its relative imports; one
    is followed with the names it brings that were in use.
    """
    resolved = settle(facts.resolve_imports(imports, files).where("target_path is not null"))
    shown = resolved.select(F.col("file_path").alias("at"), "source").distinct()
    step = settle(resolved.where("name is not null").select(F.col("file_path").alias("at"), F.coalesce("alias", "name").alias("symbol"), F.col("target_path").alias("next"), F.col("name").alias("brings")).distinct())
    front = settle(used.select("file_path", F.col("file_path").alias("at"), "symbol").distinct())
    known = front
    for _ in range(max_rounds):
        new = front.join(step, ["at", "symbol"]).select("file_path", F.col("next").alias("at"), F.col("brings").alias("symbol")).distinct()
        front = settle(new.join(known, ["file_path", "at", "symbol"], "left_anti"))
        if front.isEmpty():
            return known.select("file_path", "at").distinct().join(shown, "at").select("file_path", "source").distinct()
        known = known.union(front)
    raise RuntimeError(f"transitive_imports did not end in {max_rounds} rounds")
