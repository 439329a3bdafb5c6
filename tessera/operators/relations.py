"""Relations between symbols, read from text line by line: inheritance, calls, imports, and the references and graph that they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.sources import facts

#: Words that stand before a parenthesis without being a call.
NO_CALL = ["if", "for", "while", "switch", "catch", "return", "function", "def", "func", "fn", "class", "import", "super", "elif", "with", "and", "or", "not", "in", "await", "typeof", "new", "match"]
BASES = r"\bextends\s+([\w$.,\s<>]+?)\s*(?:\bimplements\b|\{|$)"
PYTHON_BASES = r"^\s*class\s+[\w$]+\s*\(([^)]*)\)\s*:"
PROMISED = r"\bimplements\s+([\w$.,\s<>]+?)\s*(?:\{|$)"
IN_GRAPH = ["uses", "calls", "inherits", "implements"]


def extract_relations(files: DataFrame) -> DataFrame:
    """file_path, type (inherits, implements, calls, imports), source, target, confidence, line of every relation in the files (file_path, content).

    A lexical scan: a call belongs to the nearest declaration above it in its file, a call above all declarations to none,
    so it gives no row; comment lines give none; strings are not told apart. A relation said twice on a line counts once.
    A null content gives no row. One file's lines are ordered in one task, which streams them.
    """
    ln = facts.lines(files, "file_path").where(~F.col("line").rlike(r"^\s*(//|/?\*|#)"))
    declared = F.nullif(F.regexp_extract("line", facts.DECLARATION, 3), F.lit(""))
    listed = lambda rx: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract("line", rx, 1), "<[^>]*>", ""), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[\w$.]+$"))
    is_class = F.regexp_extract("line", facts.DECLARATION, 2).isin("class", "interface", "struct", "trait")
    bases = ln.where(is_class).select("file_path", "pos", declared.alias("source"), F.concat(listed(BASES), listed(PYTHON_BASES)).alias("up"), listed(PROMISED).alias("does"))
    up = lambda column, kind: bases.select("file_path", F.lit(kind).alias("type"), "source", F.explode(column).alias("target"), F.lit(0.9).alias("confidence"), F.col("pos") + 1)

    rest = F.when(declared.isNull(), F.col("line")).otherwise(F.regexp_replace("line", facts.DECLARATION, ""))
    named = F.array_distinct(F.regexp_extract_all(F.when(is_class, F.lit("")).otherwise(rest), F.lit(r"([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))
    above = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # only lines that declare or call need an order
    held = ln.select("file_path", "pos", declared.alias("declared"), F.filter(named, lambda x: ~x.isin(NO_CALL)).alias("called")).where("declared is not null or size(called) > 0")
    held = held.withColumn("source", F.last("declared", ignorenulls=True).over(above)).where("source is not null")
    calls = held.select("file_path", F.lit("calls").alias("type"), "source", F.explode("called").alias("target"), F.lit(0.8).alias("confidence"), F.col("pos") + 1)

    stmts = facts.scan_imports(files).where("name is not null").select("file_path", "name", "source", "raw").distinct()
    before = F.left("content", F.position("raw", "content") - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    imports = stmts.join(files.select("file_path", "content"), "file_path").select("file_path", F.lit("imports").alias("type"), F.col("name").alias("source"), F.col("source").alias("target"), F.lit(1.0).alias("confidence"), line)
    return up("up", "inherits").union(up("does", "implements")).union(calls).union(imports).toDF("file_path", "type", "source", "target", "confidence", "line")


def symbol_references(declarations: DataFrame, relations: DataFrame) -> DataFrame:
    """symbol, file, line, type, context, scope: a definition for each declaration, and the target of each relation whose type stands for a reference."""
    made = declarations.select(F.col("name").alias("symbol"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.lit("definition").alias("type"), F.lit("global").alias("scope"))
    used = relations.select(F.col("target").alias("symbol"), F.col("file_path").alias("file"), "line", S.reference_kind("type").alias("type"), F.lit("unknown").alias("scope")).where("type is not null")
    return made.union(used).select("symbol", "file", "line", "type", S.reference_context("line", "file").alias("context"), "scope")


def references_of(references: DataFrame, wanted: DataFrame) -> DataFrame:
    """The references of the symbols in ``wanted`` (symbol), of any number."""
    return references.join(wanted.select("symbol").distinct(), "symbol", "left_semi")


def dependency_graph(declarations: DataFrame, relations: DataFrame) -> DataFrame:
    """src, dst: distinct edges of the relations that make one symbol need another; a declared symbol without any has a row with null dst."""
    edges = relations.where(F.col("type").isin(IN_GRAPH)).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return declarations.select(F.col("name").alias("src")).distinct().join(edges, "src", "full")


def by_type(declarations: DataFrame) -> DataFrame:
    """file_path, kind, n and names: the index of a file's declarations by kind, names in the order of their lines."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"])
    return declarations.groupBy("file_path", "kind").agg(F.count("*").alias("n"), names.alias("names"))
