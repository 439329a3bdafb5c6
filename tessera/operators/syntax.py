"""Questions about syntax nodes (``tessera.sources.syntax``): joins on node types, on ranges of pre-order numbers, and on spans of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kind of symbol that a type of node defines; a Python variable is the target of an assignment.
SYMBOLS = {
    "FunctionDef": "function", "AsyncFunctionDef": "function", "ClassDef": "class", "FunctionDeclaration": "function", "MethodDefinition": "method", "ClassDeclaration": "class", "InterfaceDeclaration": "interface", "TypeAlias": "type", "EnumDeclaration": "enum",
    "StructDeclaration": "struct", "TraitDeclaration": "trait", "ImplDeclaration": "impl", "ModuleDeclaration": "module", "MacroDeclaration": "macro", "ConstantDeclaration": "constant", "StaticDeclaration": "static", "VariableDeclaration": "variable", "PackageClause": "package",
}
IDENTIFIERS = ["Name", "Identifier"]
IMPORTS, EXPORTS = ["Import", "ImportFrom", "ImportDeclaration"], ["ExportDeclaration"]
#: Width of the cells of numbers by which ranges meet.
CELL = 64


def failures(nodes: DataFrame) -> DataFrame:
    """file_path and error of the files that could not be read."""
    return nodes.where("error is not null").select("file_path", "error")


def meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the files, by a shuffle: written nodes and symbols are far smaller as files than as rows, so a side that looks small enough to broadcast may not fit the driver."""
    return a.join(b.hint("merge"), on, how)


def within(roots: DataFrame, nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Each root (file_path, root, root_last, ...) with every node whose number lies in its range, itself included.

    An equi-join on the file and on cells of numbers: a range is sent to the cells that it overlaps, a node to one, so
    what is compared grows with the result and not with the square of a file.
    """
    r = roots.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("root") / cell), F.floor(F.col("root_last") / cell))))
    n = nodes.withColumn("_cell", F.floor(F.col("pre") / cell))
    return meet(r, n, ["file_path", "_cell"]).where("pre between root and root_last").drop("_cell")


def _kinds(nodes: DataFrame, kinds: dict[str, str], name: str) -> DataFrame:
    """nodes whose type has a kind, with it: a join with the few types."""
    of = nodes.sparkSession.createDataFrame(list(kinds.items()), f"type string, {name} string")
    return nodes.join(F.broadcast(of), "type")


def _targets(nodes: DataFrame) -> DataFrame:
    """Python's variables: names stored straight below an assignment, with the assignment's span."""
    above = nodes.where(F.col("type").isin("Assign", "AnnAssign")).select("file_path", F.col("pre").alias("parent"), F.col("last").alias("_last"), F.col("end_line").alias("_end"))
    t = meet(nodes.where((F.col("type") == "Name") & (F.col("role") == "target")), above, ["file_path", "parent"])
    return t.withColumn("last", F.col("_last")).withColumn("end_line", F.col("_end")).withColumn("kind", F.lit("variable")).drop("_last", "_end")


def symbols(nodes: DataFrame) -> DataFrame:
    """file_path, pre, last, name, kind, start_line, end_line, exported, parent, scope of what the files define.

    The parent is the innermost function, class or other symbol with a body around it; scope is ``global`` without one.
    """
    defined = _kinds(nodes.where("name is not null"), SYMBOLS, "kind")
    found = defined.unionByName(_targets(nodes).select(*defined.columns))
    bodies = found.where(~F.col("kind").isin("variable", "constant", "package", "type")).select("file_path", F.col("pre").alias("root"), F.col("last").alias("root_last"), F.col("name").alias("_around"))
    inner = within(bodies, found.select("file_path", "pre", "kind")).where("root < pre and kind <> 'package'")
    parent = inner.groupBy("file_path", "pre").agg(F.max_by("_around", "root").alias("parent"))
    out = meet(found.drop("parent"), parent, ["file_path", "pre"], "left")
    return out.select("file_path", "pre", "last", "name", "kind", F.col("line").alias("start_line"), "end_line", "exported", "parent", F.when(F.col("parent").isNull(), "global").otherwise("local").alias("scope"))


def dependencies(symbols_: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_path, pre, dependencies: the distinct identifiers below each symbol, in the order in which they come first."""
    names = nodes.where(F.col("type").isin(IDENTIFIERS)).select("file_path", "pre", "name")
    roots = symbols_.select("file_path", F.col("pre").alias("root"), F.col("last").alias("root_last"))
    first = within(roots, names).groupBy("file_path", "root", "name").agg(F.min("pre").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    found = first.groupBy("file_path", F.col("root").alias("pre")).agg(listed.alias("dependencies"))
    return meet(symbols_.select("file_path", "pre"), found, ["file_path", "pre"], "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))


def first_named(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """file_path, name, and the first node in pre-order that has the name, for the rows of ``wanted`` (file_path, name)."""
    found = meet(nodes, wanted.select("file_path", "name").distinct(), ["file_path", "name"])
    first = F.min(F.struct("pre", "last", "type", "line", "end_line")).alias("n")
    return found.groupBy("file_path", "name").agg(first).select("file_path", "name", "n.*")


def _with_lines(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans (file_path, line, end_line, ...) with code, the lines of each; a file's lines are split once and held once."""
    kept = [c for c in spans.columns if c != "file_path"]
    lists = spans.groupBy("file_path").agg(F.collect_list(F.struct(*kept)).alias("_spans"))
    held = meet(lists, files.select("file_path", F.split("content", "\n", -1).alias("_lines")), ["file_path"])
    code = lambda x: F.array_join(F.slice("_lines", x["line"], x["end_line"] - x["line"] + 1), "\n")
    cut = F.explode(F.transform("_spans", lambda x: F.struct(*[x[c].alias(c) for c in kept], code(x).alias("code")))).alias("x")
    return held.select("file_path", cut).select("file_path", "x.*")


def statements(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, pre, kind (import, export), target, code of the import and export statements; the code is their lines."""
    s = nodes.where(F.col("type").isin(*IMPORTS, *EXPORTS)).withColumn("kind", F.when(F.col("type").isin(IMPORTS), "import").otherwise("export"))
    return _with_lines(s.select("file_path", "pre", "kind", F.col("name").alias("target"), "line", "end_line"), files).select("file_path", "pre", "kind", "target", "code")


def code_of(symbols_: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with code: the lines of their spans."""
    spans = symbols_.withColumn("line", F.col("start_line"))
    return _with_lines(spans, files).select(*symbols_.columns, "code")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, name, kind, parent, change (added, removed, modified) of symbols with code whose code is not the same.

    Symbols meet by file, name, kind and parent; of several the first in the file.
    """
    key = ["file_path", "name", "kind", "_parent"]
    first = lambda df, c: df.withColumn("_parent", F.coalesce("parent", F.lit(""))).groupBy(*key).agg(F.min_by("code", "pre").alias(c))
    both = meet(first(old, "old"), first(new, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("file_path", "name", "kind", F.nullif("_parent", F.lit("")).alias("parent"), change.alias("change")).where("change is not null")


def is_scope(kind: Column) -> Column:
    return kind.isin("function", "method", "class", "module", "impl", "trait", "interface")


def variables(nodes: DataFrame, symbols_: DataFrame) -> DataFrame:
    """file_path, pre, name, kind (variable, parameter, constant), hoisted: what scopes hold.

    Parameters are Python's argument nodes. Names in capitals and declared constants are constants. Functions are hoisted
    in a scope that holds them, and here only they.
    """
    args = nodes.where("type = 'arg'").select("file_path", "pre", "name", F.lit("parameter").alias("kind"))
    capital = F.col("name").rlike("^[A-Z][A-Z0-9_]+$")
    held = symbols_.where(F.col("kind").isin("variable", "constant", "static", "function"))
    held = held.select("file_path", "pre", "name", F.when((F.col("kind") == "variable") & capital, "constant").when(F.col("kind") == "static", "constant").otherwise(F.col("kind")).alias("kind"))
    return held.unionByName(args).withColumn("hoisted", F.col("kind") == "function")


def references(nodes: DataFrame, symbols_: DataFrame) -> DataFrame:
    """file_path, symbol, kind (call, instantiation, write, read), line, referenced_by: uses of the files' own symbols.

    The kind follows from the node's type and, for names, from its role: what is called counts at the call alone, and the
    name that an assignment writes as a write. Calling a class makes an instance. The symbol that contains the use is the
    innermost one by numbers; uses outside all symbols have none.
    """
    own = symbols_.groupBy("file_path", "name").agg(F.max((F.col("kind") == "class").cast("int")).alias("_class"))
    call = F.when(F.col("_class") == 1, "instantiation").otherwise("call")
    kind = F.when(F.col("type") == "NewExpression", "instantiation").when(F.col("type").isin("Call", "CallExpression"), call)
    name = F.when(F.coalesce(F.col("role"), F.lit("")).isin("func", "callee"), None).when(F.col("role") == "target", "write").otherwise("read")
    kind = kind.when(F.col("type").isin(IDENTIFIERS), name)
    used = meet(nodes, own, ["file_path", "name"]).withColumn("kind", kind).where("kind is not null")
    bodies = symbols_.where(is_scope(F.col("kind"))).select("file_path", F.col("pre").alias("root"), F.col("last").alias("root_last"), F.col("name").alias("_around"))
    around = within(bodies, used.select("file_path", "pre")).groupBy("file_path", "pre").agg(F.max_by("_around", "root").alias("referenced_by"))
    return meet(used, around, ["file_path", "pre"], "left").select("file_path", F.col("name").alias("symbol"), "kind", "line", "referenced_by")


def relevant_code(symbols_: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, code: the code of a file's symbols in their order, a blank line between them; one inside another is part of its code alone."""
    outer = symbols_.withColumn("_reach", F.max("last").over(Window.partitionBy("file_path").orderBy("pre", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)))
    top = code_of(outer.where("_reach is null or pre > _reach"), files)
    return top.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "code"))), lambda x: x["code"]), "\n\n").alias("code"))
