"""Relations read from text, cache entries that are dropped, feedback, importances."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import mlp, relations
from tessera.sources import facts
from tessera.streaming import state

TEXT = """import { a, b as c } from './x';
import d from 'y';
call();
class P extends Q implements R, S<T> {
  // f(1)
  run() { return f(g(2)); }
}
if (a) { f(3); }
def h(x):
class U(V, W):
const k = f(4), l = f(5);"""


def test_relations_of_a_text(spark):
    f = spark.createDataFrame([("m", TEXT), ("empty", ""), ("null", None)], "file_path string, content string")
    got = relations.extract_relations(f)
    rows = {(r.type, r.source, r.target, r.line) for r in got.collect()}
    assert rows == {
        ("imports", "a", "./x", 1), ("imports", "b", "./x", 1), ("imports", "d", "y", 2),
        ("inherits", "P", "Q", 4), ("implements", "P", "R", 4), ("implements", "P", "S", 4), ("inherits", "U", "V", 10), ("inherits", "U", "W", 10),
        ("calls", "P", "run", 6), ("calls", "P", "f", 6), ("calls", "P", "g", 6), ("calls", "P", "f", 8), ("calls", "k", "f", 11),
    }
    refs = relations.symbol_references(facts.scan_declarations(f), got)
    of_f = {(r.line, r.type, r.context) for r in relations.references_of(refs, spark.createDataFrame([("f",)], "symbol string")).collect()}
    assert of_f == {(n, "call", f"Line {n} in m") for n in (6, 8, 11)}
    graph = {(r.src, r.dst) for r in relations.dependency_graph(facts.scan_declarations(f), got).collect()}
    assert graph == {("P", x) for x in ("Q", "R", "S", "run", "f", "g")} | {("U", "V"), ("U", "W"), ("k", "f"), ("h", None)}


def test_dropped_entries_miss(spark, tmp_path):
    rows = [("a", 0, False), ("a", 10, False), ("a", 20, True), ("a", 30, False), ("a", 40, False), ("b", 0, None), ("b", 5, False), ("c", 1, True)]
    src = str(tmp_path / "events")
    spark.createDataFrame(rows, "k string, s long, gone boolean").select("k", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "gone").write.parquet(src)
    e = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src).withWatermark("ts", "1 minute")
    q = state.cache_stream(e, "k", "ts", 60, "gone").writeStream.format("memory").queryName("dropped").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.k: (r.hits, r.misses) for r in spark.table("dropped").collect() if r.hits + r.misses} == {"a": (2, 2), "b": (1, 1)}


def test_feedback_is_appended_and_calls_at_each_hundred(spark, tmp_path):
    src, out, calls = tmp_path / "in", str(tmp_path / "feedback"), []
    schema = "query string, symbol string, relevance double"
    for n, want in ((60, []), (60, [120]), (30, [120]), (60, [120, 210])):
        spark.createDataFrame([("q", f"s{i}", 0.5) for i in range(n)], schema).coalesce(1).write.mode("append").parquet(str(src))
        state.append_feedback(spark.readStream.schema(schema).parquet(str(src)), out, str(tmp_path / "cp"), lambda t: calls.append(t.count())).awaitTermination()
        assert calls == want
    assert spark.read.parquet(out).count() == 210


def test_importances_are_ranked(spark):
    x = np.random.default_rng(2).normal(size=(50, 3))
    net = mlp.Network([3, 4, 1], ["tanh", "sigmoid"])
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "x array<double>")
    got = mlp.feature_importance(df.repartition(3), net, "x", ["word_count", "scope"]).orderBy("rank").collect()
    want = net.importance(x)
    assert [r.rank for r in got] == [1, 2, 3]
    names = ["word_count", "scope", "feature_2"]
    assert [r.feature for r in got] == [names[i] for i in np.argsort(-want)]
    assert np.allclose([r.importance for r in got], np.sort(want)[::-1])
    assert {r.feature: r.category for r in got} == {"word_count": "text", "scope": "context", "feature_2": "semantic"}
