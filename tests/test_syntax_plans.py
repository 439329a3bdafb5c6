"""Questions about syntax nodes send no table that grows with the files through the driver."""

from tessera.operators import syntax as ops
from tessera.plans import syntax_queries
from tessera.plans.tables import settle
from tessera.sources import syntax


def parsed(spark, call):
    files = settle(spark.createDataFrame([(f"/s{i}.py", f"def {call}(x):\n    y = x\n    return y\n\n\ndef g(x):\n    return {call}(x)\n") for i in range(20)], "file_path string, content string"))
    nodes = settle(syntax.nodes(files))
    return files, nodes, settle(ops.symbols(nodes))


def ran(df):
    """The rows of a query and its plan as it ran."""
    q = df._jdf.queryExecution()
    rows = df.collect()
    return rows, q.executedPlan().toString()


def test_references_join_by_shuffles(spark):
    _, nodes, found = parsed(spark, "f")
    rows, plan = ran(ops.references(nodes, found))
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3
    assert sorted((r.symbol, r.kind, r.line, r.referenced_by) for r in rows if r.file_path == "/s7.py") == [("f", "call", 7, "g"), ("y", "read", 3, "f"), ("y", "write", 2, "f")]


def test_changes_and_code_join_by_shuffles(spark):
    old_files, _, old = parsed(spark, "f")
    new_files, _, new = parsed(spark, "h")
    rows, plan = ran(ops.changes(ops.code_of(old, old_files), ops.code_of(new, new_files)))
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3
    assert sorted((r.name, r.parent, r.change) for r in rows if r.file_path == "/s7.py") == [("f", None, "removed"), ("g", None, "modified"), ("h", None, "added"), ("y", "f", "removed"), ("y", "h", "added")]


def test_span_changes_parses_only_files_that_differ_and_joins_by_shuffles(spark, sf, monkeypatch):
    parsed_files, nodes = [], syntax.nodes
    monkeypatch.setattr(syntax, "nodes", lambda files: (parsed_files.append({r.file_path: r.content for r in files.collect()}), nodes(files))[1])
    rows, plan = ran(syntax_queries.span_changes(spark, sf))
    texts = {r.file_path: (r.content, r.content.replace("helper(", "assist(") if r.p_partkey % 3 == 0 else r.content) for r in syntax_queries.source_files(spark, sf).collect()}
    differ = {p: t for p, t in texts.items() if t[0] != t[1]}
    assert 0 < len(differ) < len(texts)
    assert parsed_files == [{p: t[i] for p, t in differ.items()} for i in (0, 1)]
    assert {r.file_path for r in rows} <= set(differ) and "Broadcast" not in plan
