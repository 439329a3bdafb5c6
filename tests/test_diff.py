"""Line diffs: the operations rebuild both texts, hunks and their application."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import diff
from tessera.plans import catalog

texts = st.lists(st.sampled_from("abc"), max_size=8).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(texts, texts)
def test_operations_rebuild_both_texts(old, new):
    ops = diff.diff_ops(old, new)
    assert "\n".join(t for op, _, _, t in ops if op != "added") == old
    assert "\n".join(t for op, _, _, t in ops if op != "removed") == new
    kept = sum(op == "unchanged" for op, *_ in ops)
    a, b = old.split("\n"), new.split("\n")
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert kept == best[-1][-1]


def hunks(spark, old, new):
    pairs = spark.createDataFrame([(1, old, new)], "key int, old string, new string")
    return diff.hunks(diff.line_diff(pairs, "key"), "key")


def test_modified_hunk(spark):
    h = hunks(spark, "a\nb\nc\nd", "a\nb2\nc2\nd").collect()
    assert [(x.type, x.old_start, x.old_end, x.new_start, x.new_end, x.content) for x in h] == [("modified", 2, 3, 2, 3, "b2\nc2")]


def test_apply_hunks():
    changes = [
        {"type": "removed", "old_start": 2, "old_end": 2, "new_start": None, "new_end": None, "content": "line2"},
        {"type": "modified", "old_start": 3, "old_end": 3, "new_start": 2, "new_end": 2, "content": "x3"},
        {"type": "added", "old_start": None, "old_end": None, "new_start": 4, "new_end": 4, "content": "inserted"},
    ]
    assert diff.apply_hunks("line1\nline2\nline3\nline4", changes, parity=True) == "line1\nx3\ninserted\nline4"


def test_context_lines(spark):
    old, new = "A\nB\nC\nD\nE\nF", "A\nB\nX\nY\nE\nF"
    lines = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(new.split("\n"))], "key int, pos int, line string")
    got = diff.contextual(hunks(spark, old, new), lines, "key", 1).collect()
    assert [(x.type, x.content) for x in got] == [("modified", "B\nX\nY\nE")]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=3, max_size=6))
def test_hunks_rebuild_the_new_text(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "key int, old string, new string")
    found = {}
    for r in diff.hunks(diff.line_diff(df, "key"), "key").orderBy("hunk").collect():
        found.setdefault(r.key, []).append(r.asDict())
    for i, (a, b) in enumerate(pairs):
        assert diff.apply_hunks(a, found.get(i, [])) == b


def test_summary(spark):
    df = spark.createDataFrame([(1, 2, 0), (0, 0, 0)], "a int, r int, m int").select(diff.summary(F.col("a"), F.col("r"), F.col("m")).alias("s"))
    assert [r.s for r in df.collect()] == ["1 addition, 2 deletions", "No changes detected"]


def test_every_document_is_compared_whatever_the_size_of_its_group(spark, tmp_path):
    line = "a line that all the versions have in common"
    docs = [(i, f"{line}\nversion {i}") for i in range(1, 9)] + [(9, f"{line}\nversion 1"), (10, f"nothing else\n{line}\na second line that only two of them hold"), (11, "a second line that only two of them hold\nx"), (12, "a text that is alone with its own line"), (13, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lines = {i: {x for x in (t or "").split("\n") if len(x) >= 20} for i, t in docs}
    text = dict(docs)
    want = {f"{a}-{b}" for b in lines for x in lines[b] for a in [min(i for i in lines if x in lines[i])] if a < b and text[a] != text[b]}
    assert {f"1-{i}" for i in (2, 3, 4, 5, 6, 7, 8, 10)} | {"10-11"} == want
    for name in ("line_diff", "diff_hunks", "contextual_diff", "diff_summary"):
        assert {r.key for r in catalog.QUERIES[name](spark, str(tmp_path)).select("key").distinct().collect()} == want


def test_summary_names_every_kind(spark):
    df = spark.createDataFrame([(1, 1, 1), (3, 0, 2)], "a int, r int, m int").select(diff.summary(F.col("a"), F.col("r"), F.col("m")).alias("s"))
    assert [r.s for r in df.collect()] == ["1 addition, 1 deletion, 1 modification", "3 additions, 2 modifications"]


def plain_ops(old, new):
    """The same rule with the whole table."""
    a, b = old.split("\n"), new.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], len(x), len(y)
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("unchanged", head + i + 1, head + j + 1, x[i]))
        elif j and (not i or t[i][j - 1] >= t[i - 1][j]):
            j -= 1
            out.append(("added", None, head + j + 1, y[j]))
        else:
            i -= 1
            out.append(("removed", head + i + 1, None, x[i]))
    return [("unchanged", k + 1, k + 1, a[k]) for k in range(head)] + out[::-1]


longer = st.lists(st.sampled_from("abcd"), max_size=30).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(longer, longer)
def test_rows_made_again_give_the_whole_tables_path(old, new):
    assert diff.diff_ops(old, new) == plain_ops(old, new)


def test_long_texts_take_little_memory():
    import tracemalloc

    a, b = ("\n".join(str(i * k % 4001) for i in range(4000)) for k in (7, 11))
    tracemalloc.start()
    diff.diff_ops(a, b)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20  # the whole table takes 64 MB
    tracemalloc.stop()


def test_functions_for_sql(spark):
    from tessera import sql

    sql.register(spark)
    spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "q")], "k int, old string, new string").createOrReplaceTempView("v")
    rows = spark.sql("select k, d.* from v, lateral line_diff(v.old, v.new) d order by k, seq").collect()
    assert [(r.op, r.line) for r in rows if r.k == 1] == [("unchanged", "a"), ("removed", "b"), ("added", "x"), ("unchanged", "c"), ("added", "d")]
    diff.hunks(diff.line_diff(spark.table("v"), "k"), "k").createOrReplaceTempView("h")
    made = spark.sql("select v.k, v.new, apply_hunks(v.old, g.hs) t from v join (select k, array_sort(collect_list(struct(hunk, type, old_start, old_end, new_start, new_end, content))) hs from h group by k) g on g.k = v.k")
    assert all(r.new == r.t for r in made.collect()) and made.count() == 2
    assert [tuple(r) for r in spark.sql("select * from declarations('export class A {}\n  def f(x):')").collect()] == [("A", "class", 1, True), ("f", "function", 2, False)]


@pytest.mark.parametrize("kept", [2, 64])
def test_lines_of_one_side_and_kept_points_change_no_operation(monkeypatch, kept):
    monkeypatch.setattr(diff, "KEPT", kept)
    r = random.Random(kept)
    for _ in range(400):
        a = [r.choice("abcde") for _ in range(r.randrange(40))]
        b = [x if r.random() < 0.7 else r.choice("abcxyz") for x in a if r.random() < 0.8]
        old, new = "\n".join(a), "\n".join(b)
        assert diff.diff_ops(old, new) == plain_ops(old, new)


def test_time_follows_the_changes():
    a = [str(i) for i in range(300_000)]
    b = list(a)
    for i in range(5, len(b), 3000):
        b[i] = "x"
    start = time.time()
    ops = diff.diff_ops("\n".join(a), "\n".join(b))  # 9e10 pairs of lines, 100 changed
    assert time.time() - start < 20 and sum(o[0] != "unchanged" for o in ops) == 200
