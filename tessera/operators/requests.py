"""Request-level operators over many requests at once: minimal contexts, cached contexts, diffs and import pruning with savings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import diff, graph, relational, text
from tessera.sources import facts


def extract_code_context(requests: DataFrame, files: DataFrame, symbols: DataFrame, settle: Callable[[DataFrame], DataFrame], imports: DataFrame | None = None, max_tokens: int = 1000) -> DataFrame:
    """file_path, extracted_code, imports, symbols, dependencies, token_count, relevance_score of each request.

    requests (file_path, targets array: empty for all), files (file_path, content), symbols (file_path, name, start_line,
    end_line, dependencies array), imports (file_path, stmt_pos, raw). The symbols are those reachable from the targets over
    dependencies inside the file; the code is their lines, cut to the budget that the imports leave.
    """
    node = lambda n: F.concat_ws("\x00", "file_path", n)
    dep = symbols.select("file_path", "name", F.explode("dependencies").alias("to")).where("name <> to")
    edges = dep.select(node("name").alias("src"), node("to").alias("dst")).distinct()
    wanted = requests.select("file_path", F.explode("targets").alias("name"))
    reach = graph.closure(edges, settle, seeds=wanted.select(node("name").alias("src"))).select(F.col("dst").alias("node"))
    everything = requests.where(F.size("targets") == 0).select("file_path")
    near = wanted.select(node("name").alias("node")).union(reach).distinct()
    kept = symbols.join(near, node("name") == F.col("node"), "left_semi").unionByName(symbols.join(everything, "file_path", "left_semi"))
    kept = kept.select("file_path", "name", "start_line", "end_line", "dependencies").distinct()

    lines = facts.lines(files, "file_path").withColumn("line_no", F.col("pos") + 1)
    spans = kept.select("file_path", "name", "start_line", "end_line", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    code = spans.join(lines, ["file_path", "line_no"]).groupBy("file_path", "name", "start_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("code"))
    body = code.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name", "code"))), lambda x: x["code"]), "\n\n").alias("code"))
    listed = kept.groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("symbols"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dependencies")))).alias("dependencies"))
    out = requests.join(body, "file_path", "left").join(listed, "file_path", "left")
    none = F.array().cast("array<string>")
    if imports is not None:
        i = imports.select("file_path", "stmt_pos", "raw").distinct().groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("stmt_pos", "raw"))), lambda x: x["raw"]).alias("imports"))
        out = out.join(i, "file_path", "left")
    else:
        out = out.withColumn("imports", none)
    out = out.select("file_path", "targets", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("symbols", none).alias("symbols"), F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("imports", none).alias("imports"))
    out = out.withColumn("import_tokens", F.aggregate("imports", F.lit(0).cast("long"), lambda a, x: a + S.token_estimate(x)))
    cut = text.token_budget(out, "code", max_tokens, "import_tokens")
    return cut.select("file_path", F.col("kept_text").alias("extracted_code"), "imports", "symbols", "dependencies", (F.col("token_count") + F.col("import_tokens")).alias("token_count"), S.relevance("symbols", "targets").alias("relevance_score"))


def analyze_code_diff(versions: DataFrame, key: str) -> DataFrame:
    """key, affected symbols, minimal update, tokens of the new text and of the update, and what is saved.

    versions (key, old, new): symbols are declarations, their code the declaring line; a change is one of that line.
    """
    def declared(side: str) -> DataFrame:
        f = versions.select(F.col(key).cast("string").alias("file_path"), F.coalesce(side, F.lit("")).alias("content"))
        d = facts.scan_declarations(f)
        at = facts.lines(f, "file_path").select("file_path", (F.col("pos") + 1).alias("start_line"), F.trim("line").alias("code"))
        first = d.groupBy("file_path", F.col("name").alias("symbol")).agg(F.min("start_line").alias("start_line"))
        return first.join(at, ["file_path", "start_line"])

    old, new = declared("old"), declared("new")
    changes = relational.symbol_diff(old, new, ["file_path", "symbol"])
    place = new.select("file_path", "symbol", F.col("start_line").alias("line"))
    changes = changes.join(place, ["file_path", "symbol"], "left").fillna(0, ["line"])
    update = diff.update_text(changes, "file_path").withColumnRenamed("text", "minimal_update")
    affected = changes.groupBy("file_path").agg(F.array_sort(F.collect_set("symbol")).alias("affected"))
    out = versions.select(F.col(key).cast("string").alias("file_path"), "new").join(update, "file_path", "left").join(affected, "file_path", "left")
    whole, part = S.token_estimate(F.coalesce("new", F.lit(""))), S.token_estimate(F.coalesce("minimal_update", F.lit("")))
    return out.select(F.col("file_path").alias(key), F.coalesce("affected", F.array().cast("array<string>")).alias("affected"), F.coalesce("minimal_update", F.lit("")).alias("minimal_update"), whole.alias("new_tokens"), part.alias("update_tokens"), (whole - part).alias("token_savings"))


def optimize_imports(specifiers: DataFrame, used: DataFrame, suggested: DataFrame | None = None, cycles: DataFrame | None = None) -> DataFrame:
    """file_path, optimized, removed, added, warnings, token_savings of the files' import statements.

    specifiers as of ``facts.scan_imports``; used (file_path, symbol). A statement stays whole if one of its names is used.
    suggested (symbol, statement): what to import for used names that no statement of the file brings; these come after the
    kept ones. added and removed are the differences of the sets before and after. cycles (path array): as of
    ``graph.cycles`` over files. Warnings name removed side-effect imports, then the cycles that the file is on.
    """
    local = specifiers.withColumn("symbol", F.coalesce("alias", "name"))
    names = used.select("file_path", "symbol").distinct()
    kept = local.where("symbol is not null").join(names, ["file_path", "symbol"], "left_semi").unionByName(local.where("symbol is null")).select("file_path", "stmt_pos").distinct().withColumn("keep", F.lit(True))
    s = specifiers.groupBy("file_path", "stmt_pos", "raw").agg(F.max(F.col("name").isNull()).alias("bare")).join(kept, ["file_path", "stmt_pos"], "left")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("stmt_pos", "raw")))), lambda x: x["raw"])
    keep = F.coalesce("keep", F.lit(False))
    out = s.groupBy("file_path").agg(pick(F.lit(True)).alias("original"), pick(keep).alias("optimized"), pick(~keep & F.col("bare")).alias("side"), F.sum(F.when(~keep, S.token_estimate("raw")).otherwise(0)).alias("token_savings"))
    none = F.array().cast("array<string>")
    if suggested is not None:
        missing = names.join(local.select("file_path", "symbol"), ["file_path", "symbol"], "left_anti")
        more = missing.join(suggested.groupBy("symbol").agg(F.min("statement").alias("statement")), "symbol").groupBy("file_path").agg(F.array_sort(F.collect_set("statement")).alias("more"))
        out = out.join(more, "file_path", "full").select("file_path", *[F.coalesce(c, none).alias(c) for c in ("original", "side")], F.concat(F.coalesce("optimized", none), F.coalesce("more", none)).alias("optimized"), F.coalesce("token_savings", F.lit(0)).alias("token_savings"))
    warnings = F.transform("side", lambda x: F.concat(F.lit("side effect lost: "), x))
    if cycles is not None:
        on = cycles.select(F.explode(F.array_distinct("path")).alias("file_path"), F.array_join("path", " -> ").alias("cycle")).groupBy("file_path").agg(F.array_sort(F.collect_set("cycle")).alias("cycles"))
        out = out.join(on, "file_path", "left")
        warnings = F.concat(warnings, F.transform(F.coalesce("cycles", none), lambda x: F.concat(F.lit("import cycle: "), x)))
    return out.select("file_path", "optimized", F.array_except("original", "optimized").alias("removed"), F.array_except("optimized", "original").alias("added"), warnings.alias("warnings"), "token_savings")


def import_suggestions(undefined: DataFrame, packages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Packages for undefined symbols, best first."""
    return relational.suggest_imports(undefined, packages, threshold).orderBy(F.desc("confidence"), "symbol", "package")
