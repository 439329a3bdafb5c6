"""Operators on small literal tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import scalars as S
from tessera.operators import cache, graph, mlp, relational, scopes, text, vectors
from tessera.plans.tables import settle
from tessera.sources import facts
from tessera.streaming import state


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


GRAPHS = [[], [(1, 1)], [(1, 2), (2, 1)], [(1, 2), (1, 3), (2, 4), (3, 4)], [(i, i + 1) for i in range(5)], [(1, 2), (3, 4), (4, 5)]]


@pytest.mark.parametrize("pairs", GRAPHS)
def test_closure_and_components(spark, pairs):
    reach = {(a, b) for a, b in pairs}
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    assert {(r.src, r.dst) for r in graph.closure(edges(spark, pairs), settle).collect()} == reach
    both = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    near = {a: {a} for p in pairs for a in p}
    for _ in near:
        near = {a: s | {c for b, c in both if b in s} for a, s in near.items()}
    want = {a: min(s) for a, s in near.items() if len(s) > 1}
    assert {r.node: r.component for r in graph.connected_components(edges(spark, pairs), settle).collect()} == want


def test_layers_and_cycles(spark):
    got = {r.node: r.layer for r in graph.layers(edges(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (6, 4)]), settle).collect()}
    assert got == {3: 0, 2: 1, 1: 2, 4: None, 5: None, 6: None}
    found = {tuple(r.path) for r in graph.cycles(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 1), (4, 4)]), settle).collect()}
    assert found == {(1, 2, 1), (1, 2, 3, 1), (4, 4)}


def brute_cycles(pairs):
    near, out = {}, set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def walk(path):
        for n in near.get(path[-1], ()):
            if n == path[0]:
                out.add((*path, n))
            elif n > path[0] and n not in path:
                walk([*path, n])

    for a in near:
        walk([a])
    return out


def test_cycles_match_brute_force_at_any_length(spark):
    r = random.Random(4)
    pairs = [(100 * g + r.randrange(n), 100 * g + r.randrange(n)) for g, (n, m) in enumerate([(3, 9), (6, 14), (7, 18), (8, 16), (9, 15), (1, 2), (12, 14)]) for _ in range(m)]
    pairs += [(900 + i, 900 + (i + 1) % 14) for i in range(14)] + [(909, 903)]
    for starts in (64, 2):
        got = [(tuple(x.path), x.length) for x in graph.cycles(edges(spark, pairs), settle, starts=starts).collect()]
        assert len(got) == len(set(got)) and {p for p, _ in got} == brute_cycles(pairs) and all(n == len(p) - 1 for p, n in got)
    split = graph.cycles(edges(spark, pairs), settle, max_edges=17)  # weak components that are too large are split into strong ones
    assert {tuple(x.path) for x in split.collect()} == brute_cycles(pairs)
    with pytest.raises(ValueError, match="1[56] edges"):
        graph.cycles(edges(spark, pairs), settle, max_edges=14)
    assert graph.cycles(edges(spark, [(1, 2), (2, 3)]), settle).count() == 0


def test_import_paths_fold_any_depth_and_dotted_folders(spark):
    deep = "/".join("abcdefghijklmnopqrst")
    cases = {
        ("/src/v1.2/m.ts", "../x"): "/src/x.ts", ("/p/my.app/m.ts", "../lib/x"): "/p/lib/x.ts", (f"/r/{deep}/m.ts", "../" * 20 + "top"): "/r/top.ts", ("/p/a/b/m.ts", "./.././x"): "/p/a/x.ts",
        ("/p/a/m.ts", "./b/./../c"): "/p/a/c.ts", ("/m.ts", "../../x"): "/x.ts", ("q/m.ts", "../../x"): "../x.ts", ("/p/..a/m.ts", "../.b/x"): "/p/.b/x.ts", ("/p/a/m.ts", "."): "/p/a/index.ts",
    }
    imports = spark.createDataFrame([(a, b, "m") for a, b in cases], "file_path string, source string, name string")
    known = spark.createDataFrame([(t,) for t in cases.values()] + [("/src/v1.x.ts",), ("/p/my.lib/x.ts",)], "file_path string")
    assert {(r.file_path, r.source): r.target_path for r in facts.resolve_imports(imports, known).collect()} == cases


def test_budget_keeps_nothing_over_a_long_first_line(spark):
    df = spark.createDataFrame([(1, "x" * 29), (2, "ab\ncd"), (3, "")], "id int, t string")
    got = {r.id: (r.kept_lines, r.token_count, r.kept_text) for r in text.token_budget(df, "t", 5).collect()}
    assert got == {1: (0, 0, ""), 2: (2, 2, "ab\ncd"), 3: (1, 0, "")}


def test_imports(spark):
    src = "import a from './a';\nimport { b, c as d } from \"pkg\";\nimport 'side';\nimport * as n from '../n';\nconst x = import('dyn');"
    files = spark.createDataFrame([("/p/src/m.ts", src), ("/p/src/a.ts", ""), ("/p/n/index.js", ""), ("/p/package.json", "{}")], "file_path string, content string")
    s = facts.scan_imports(files)
    got = {(r.source, r.name, r.alias, r.is_default, r.is_namespace) for r in s.collect()}
    assert got == {("./a", "a", None, True, False), ("pkg", "b", None, False, False), ("pkg", "c", "d", False, False), ("side", None, None, None, None), ("../n", "n", None, False, True), ("dyn", None, None, None, None)}
    used = spark.createDataFrame([("d",)], "symbol string")
    assert {r.source for r in relational.minimal_imports(s, used).collect()} == {"pkg", "side", "dyn"}
    to = {r.source: r.target_path for r in facts.resolve_imports(s, files).collect()}
    assert to["./a"] == "/p/src/a.ts" and to["../n"] == "/p/n/index.js" and to["pkg"] is None
    assert {r.file_path: r.manifest_path for r in facts.nearest_manifest(files).collect()}["/p/src/m.ts"] == "/p/package.json"


def test_declarations(spark):
    src = "export class A {}\nfunction f() {}\n  const k = 1\ndef g():\nfunc (r *T) Run() {}\npub fn h() {}\nx = 1"
    files = spark.createDataFrame([("m", src)], "file_path string, content string")
    got = [(r.name, r.kind, r.start_line, r.exported) for r in facts.scan_declarations(files).orderBy("start_line").collect()]
    assert got == [("A", "class", 1, True), ("f", "function", 2, False), ("k", "constant", 3, False), ("g", "function", 4, False), ("Run", "function", 5, True), ("h", "function", 6, True)]


def test_symbol_diff(spark):
    o = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", ""), ("d", "4")], "symbol string, code string")
    n = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "5"), ("e", "")], "symbol string, code string")
    assert {r.symbol: r.change for r in relational.symbol_diff(o, n, ["symbol"]).collect()} == {"b": "modified", "c": "added", "d": "removed"}


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(S.utf16_length(F.lit("a😀"))) == 3
    assert pick(S.token_estimate(F.lit("12345"))) == 2
    assert pick(S.identifier_tokens(F.lit("myHTTPServer_name-x"))) == ["my", "httpserver", "name", "x"]
    assert pick(S.cache_key(F.lit("p"), F.array(F.lit("b"), F.lit("a")), F.lit(True))) == "p:a,b:with-imports"
    assert pick(S.path_allowed(F.lit("src/a/b.ts"), ["src/**"], ["**/*.py"])) is True
    assert pick(S.path_allowed(F.lit("src/a/b.py"), ["src/**"], ["**/*.py"])) is False
    assert pick(S.render_import(F.lit("m"), F.lit("d"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b as c")))) == "import d, { a, b as c } from 'm';"
    assert pick(S.language(F.lit("x/y.rs")) if hasattr(S, "language") else facts.language(F.lit("x/y.rs"))) == "rust"


def test_scopes(spark):
    s = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, 10, 50), ("f", 3, 20, 30), ("f", 4, 60, 70)], "file string, scope_id int, start_line int, end_line int")
    tree = scopes.scope_tree(s)
    assert {r.scope_id: (r.parent_id, r.depth) for r in tree.collect()} == {1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (1, 1)}
    p = spark.createDataFrame([(1, "f", 25), (2, "f", 55), (3, "f", 200)], "point_id int, file string, line int")
    assert {r.point_id: r.scope_id for r in scopes.innermost(p, tree).collect()} == {1: 3, 2: 1, 3: None}


def test_eviction_frees_the_target(spark):
    df = spark.createDataFrame([(i, (i * 37 % 101) / 101, i % 7 + 1) for i in range(60)], "key int, score double, size int")
    for target in (0, 1, 40, 10_000):
        left, want, freed = sorted(df.collect(), key=lambda r: (r.score, r.key)), set(), 0
        for r in left:
            if freed >= target:
                break
            want.add(r.key)
            freed += r["size"]
        assert {r.key for r in cache.evict_until(df, target).collect()} == want


def test_network_learns_and_round_trips(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = np.eye(2)[(x[:, 0] * x[:, 1] > 0).astype(int)]
    net = mlp.Network([2, 16, 2], ["tanh", "softmax"]).fit(x, y, epochs=60)
    assert (net.predict(x).argmax(1) == y.argmax(1)).mean() > 0.9
    again = mlp.Network.from_json(net.to_json())
    assert np.allclose(again.predict(x), net.predict(x))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x[:20])], "key int, v array<double>")
    assert [q.cls for q in mlp.predict(df, net, "key", "v").orderBy("key").collect()] == net.predict(x[:20]).argmax(1).tolist()


def test_gradients_match_differences():
    r = np.random.default_rng(1)
    for act in (["relu", "linear"], ["sigmoid", "softmax"], ["tanh", "sigmoid"]):
        net, x, y = mlp.Network([3, 4, 2], act), r.normal(size=(5, 3)), r.random((5, 2))
        loss = lambda net=net, x=x, y=y: ((net.predict(x) - y) ** 2).sum() / len(x)
        dw, _ = net.gradients(x, y, np.ones(5), net.forward(x))
        for k in (0, 1):
            net.weights[k][0, 0] += 1e-6
            up = loss()
            net.weights[k][0, 0] -= 2e-6
            down = loss()
            net.weights[k][0, 0] += 1e-6
            assert abs((up - down) / 2e-6 - dw[k][0, 0]) < 1e-5


def test_cosine_topk_exact(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    got = vectors.cosine_topk(v, v.where("key = 7"), 5).orderBy("rank").collect()
    rows = {r.key: np.array(r.v) for r in v.collect()}
    s = sorted(((-float(rows[7] @ x / np.linalg.norm(x) / np.linalg.norm(rows[7])), k) for k, x in rows.items() if k != 7))[:5]
    assert [r.key for r in got] == [k for _, k in s]


def test_config(tmp_path):
    store, seen = config.Store(), []
    store.callbacks.append(seen.append)
    store.update({"cache": {"policy": "lfu"}})
    with pytest.raises(ValueError):
        store.update({"cache": {"policy": "none"}})
    assert store.current.cache.policy == "lfu" and len(seen) == 1 and store.reset().cache.policy == "lru"
    path = tmp_path / "c.json"
    assert config.Settings.load(str(path)) == config.Settings()
    path.write_text(json.dumps({"budget": {"max_tokens": 7}}))
    assert config.Settings.load(str(path)).budget.max_tokens == 7


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_cosine_join_of_every_row_is_exact(spark, spread):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(12, 6))[r.integers(0, 12, 380)] + spread * r.normal(size=(380, 6)), np.zeros((2, 6)), np.ones((18, 6))])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None)], "key long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 12) + 0.0
    want = {(i, int(j), n) for i in range(len(x)) for n, j in enumerate([j for j in np.lexsort((np.arange(len(x)), -s[i])) if j != i and s[i, j] >= -0.2][:7], 1)}
    for sizes in ((16, 50, 30), (1, 4096, 1024), (400, 5, 7)):
        got = vectors.cosine_topk(df, df, 7, -0.2, *sizes).collect()
        assert {(t.query_id, t.key, t["rank"]) for t in got} == want and all(abs(t.score - s[t.query_id, t.key]) < 1e-11 for t in got)
    assert vectors.cosine_topk(df, df.where("key = 900")).count() == 0 and vectors.cosine_topk(df.limit(0), df).count() == 0


def test_stream_cache_and_file_watch(spark, sf, tmp_path):
    e = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf)
    e = e.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    q = state.cache_stream(e, "user_id", "ts", 3600).writeStream.format("memory").queryName("cache_counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: (r.hits, r.misses) for r in spark.table("cache_counts").where("hits + misses > 0").collect()}
    want = cache.hit_rates(cache.access_outcomes(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", 3600), "user_id")
    assert got == {r.user_id: (r.hits, r.misses) for r in want.collect()}

    folder, out = tmp_path / "src", str(tmp_path / "facts")
    folder.mkdir()
    run = lambda: state.reanalyse_on_change(state.watch_files(spark, str(folder)), lambda f: facts.lines(f, "file_path"), out, str(tmp_path / "cp")).awaitTermination()
    (folder / "a.txt").write_text("one\ntwo")
    run()
    (folder / "b.txt").write_text("three")
    run()
    assert sorted(r.line for r in state.current_facts(spark, out).collect()) == ["one", "three", "two"]


def test_requests(spark):
    from tessera.operators import features, requests

    src = "import a from './a';\nimport 'side';\nfunction f() {\n  return g()\n}\nfunction g() {\n  return 1\n}\nclass H {}"
    files = spark.createDataFrame([("m.ts", src)], "file_path string, content string")
    symbols = spark.createDataFrame([("m.ts", "f", 3, 5, ["f", "g"]), ("m.ts", "g", 6, 8, []), ("m.ts", "H", 9, 9, [])], "file_path string, name string, start_line int, end_line int, dependencies array<string>")
    ask = lambda t: spark.createDataFrame([("m.ts", t)], "file_path string, targets array<string>")
    imports = facts.scan_imports(files)
    one = requests.extract_code_context(ask(["f"]), files, symbols, settle, imports).first()
    assert one.symbols == ["f", "g"] and one.extracted_code.startswith("function f") and "class H" not in one.extracted_code and one.relevance_score == 1.0 and len(one.imports) == 2
    assert requests.extract_code_context(ask([]), files, symbols, settle, imports, max_tokens=10).first().token_count <= 10
    assert requests.extract_code_context(ask(["none"]), files, symbols, settle).first().extracted_code == ""
    got = requests.optimize_imports(imports, spark.createDataFrame([("m.ts", "zzz")], "file_path string, symbol string")).first()
    assert got.optimized == ["import 'side';"] and got.removed == ["import a from './a';"] and got.token_savings == 5
    v = spark.createDataFrame([(1, src, src.replace("function g()", "function g(x)").replace("class H {}", "")), (2, src, src)], "k int, old string, new string")
    d = {r.k: r for r in requests.analyze_code_diff(v, "k").collect()}
    assert d["1"].affected == ["H", "g"] and "// REMOVE H" in d["1"].minimal_update and d["2"].minimal_update == "" and d["2"].token_savings == d["2"].new_tokens
    s = spark.createDataFrame([("UserModel", "class"), ("UserView", "class"), ("UserController", "class"), ("sortStrategy", "class"), ("Single", "class")], "name string, kind string")
    r = spark.createDataFrame([("Single", "theInstance", "contains"), ("UserModel", "notifyAll", "calls")], "src string, dst string, type string")
    below = spark.createDataFrame([("sortStrategy", 3)], "src string, n int")
    assert {x.type for x in features.patterns(s, r, below).collect()} == {"mvc", "strategy", "singleton", "observer"}


def test_strong_components(spark):
    import random

    r = random.Random(2)
    for n, m in ((6, 9), (25, 40), (40, 50)):
        pairs = list({(r.randrange(n), r.randrange(n)) for _ in range(m)})
        reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
        for _ in range(n):
            reach = {a: s | {d for c in s for d in reach.get(c, ())} for a, s in reach.items()}
        want = {a: min(b for b in s if a in reach.get(b, ())) for a, s in reach.items() if a in s}
        assert {x.node: x.component for x in graph.strong_components(edges(spark, pairs), settle).collect()} == want
    assert graph.strong_components(edges(spark, []), settle).count() == 0


def test_scope_tree_matches_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(f"f{i % 3}", i, a := r.randrange(60), a + r.randrange(40)) for i in range(150)]
    got = {x.scope_id: (x.parent_id, x.depth) for x in scopes.scope_tree(spark.createDataFrame(rows, "file string, scope_id int, start_line int, end_line int").withColumn("depth", F.lit(9))).collect()}
    for f, i, a, b in rows:
        around = sorted([(x, -y, j) for g, j, x, y in rows if g == f and y >= b and (x, -y, j) < (a, -b, i)])
        assert got[i] == (around[-1][2] if around else None, len(around))
    v = spark.createDataFrame([(i, f"n{i % 5}") for _, i, _, _ in rows], "scope_id int, name string")
    tree = scopes.scope_tree(spark.createDataFrame(rows, "file string, scope_id int, start_line int, end_line int"))
    seen = {(x.scope_id, x.name): x.origin for x in scopes.accessible(tree, v, scopes.ancestors(tree, settle)).collect()}
    for _, i, _, _ in rows:
        at, names = i, {}
        while at is not None:
            names.setdefault(f"n{at % 5}", at)
            at = got[at][0]
        assert {n: o for (s, n), o in seen.items() if s == i} == names


@pytest.mark.parametrize("limit", [40, 7])
def test_scope_tree_of_a_file_cut_into_ranges(spark, limit):
    r = random.Random(limit)
    rows = [(f"f{min(i % 9, 1)}", i, a := r.randrange(200), a + r.choice((3, 30, 300))) for i in range(260)] + [("g", 1000 + i, i, 500 - i) for i in range(120)] + [("h", 2000, 0, 9)]
    df = spark.createDataFrame(rows, "file string, scope_id int, start_line int, end_line int")
    whole, cut = ({x.scope_id: (x.parent_id, x.depth) for x in scopes.scope_tree(df, n).collect()} for n in (10_000, limit))
    assert whole == cut and len(cut) == len(rows)
    assert cut[1119] == (1118, 119) and cut[2000] == (None, 0)


def test_deep_nesting_takes_linear_time(spark):
    n = 60_000
    df = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("scope_id"), F.col("id").alias("start_line"), (3 * n - F.col("id")).alias("end_line"))
    t = scopes.scope_tree(df)
    assert t.where("depth = scope_id and (parent_id = scope_id - 1 or scope_id = 0)").count() == n


def test_shadow_severity_and_captures(spark):
    v = spark.createDataFrame([("f", "a", 1, 0, False, False), ("f", "a", 2, 1, True, True), ("f", "a", 3, 2, False, True), ("f", "b", 1, 0, False, False), ("f", "b", 2, 1, False, True), ("g", "b", 9, 1, False, True)], "file string, name string, scope_id int, depth int, is_parameter boolean, is_constant boolean")
    got = {(r.name, r.scope_id): (r.shadows, r.severity) for r in scopes.shadowing(v).collect()}
    assert got == {("a", 3): (2, "warning"), ("a", 2): (1, "warning"), ("b", 2): (1, "error")}


def test_suggestions_match_brute_force(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 11)))
    names = sorted({word() for _ in range(60)} | {""})
    packages = sorted({word() for _ in range(60)} | {"Abcdabcd"})
    s, p = spark.createDataFrame([(x,) for x in names], "symbol string"), spark.createDataFrame([(x,) for x in packages], "package string")
    for t in (0.3, 0.6, 0.8):
        want = {(a, b) for a in names for b in packages if a and b and (max(len(a), len(b)) - distance(a.lower(), b.lower())) / max(len(a), len(b)) > t}
        assert {(x.symbol, x.package) for x in relational.suggest_imports(s, p, t).collect()} == want, t


def test_bottom_share_and_policies(spark):
    rows = [(i, (i * 37 % 50) / 50, 10) for i in range(97)]
    df = spark.createDataFrame(rows, "key int, score double, size int")
    order = [k for k, s, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    for share in (0.0, 0.01, 0.2, 0.5, 1.0):
        assert {r.key for r in cache.bottom_share(df, share).collect()} == set(order[: int(share * 97)])
    assert cache.bottom_share(df, 0.2, capacity=10_000).count() == 0 and cache.bottom_share(df, 0.2, capacity=1000).count() == 19
    assert cache.bottom_share(df, 0.001, parity=True).count() == 97
    e = spark.createDataFrame([(1, 0.1, 0, 1), (2, 0.9, 950, 100), (3, 0.4, 700, 30)], "key int, relevance double, last_ms long, accesses int")
    gone = lambda p: {r.key for r in cache.evictions_by_policy(e, p, 1000, 200, 0.3).collect()}
    assert gone("lru") == {1, 3} and gone("ttl") == {1} and gone("lfu") == {1} and gone("fifo") == {1}
    o = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "k int, t int, hit boolean")
    got = {r.k: (r.hit_rate, r.miss_rate) for r in cache.rate_recurrence(o, "k", "t").collect()}
    # after a hit (1, 0); a miss: (0 * 1 + 1) / 2; a hit: (1 * 1.5 + 1) / 2.5
    assert got == {1: (1.0, 0.5), 2: (0.0, 1.0)}


def test_macro_f1_is_of_the_means(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 3 + [(1, 1)] * 2 + [(2, 0)] * 4
    m = relational.macro_scores(spark.createDataFrame(rows, "a int, p int"), "a", "p").first()
    p, r = (5 / 9 + 2 / 5) / 2, (5 / 8 + 2 / 2 + 0) / 2
    assert abs(m.precision - p) < 1e-9 and abs(m.recall - r) < 1e-9 and abs(m.f1 - 2 * p * r / (p + r)) < 1e-9


def test_cosine_ties_keep_the_smallest_keys(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500, 0, -1)], "key long, v array<double>")
    got = vectors.cosine_topk(v, v.where("key = 400"), 5).orderBy("rank").collect()
    assert [r.key for r in got] == [1, 2, 3, 4, 5]


def test_code_models_are_weighted(spark):
    from tessera.operators import relevance

    rows = [(i, ["get", "user", f"w{i % 3}"], ["fn", "block"], ["auth", f"s{i % 2}"]) for i in range(12)]
    t = spark.createDataFrame(rows, "key int, tokens array<string>, structure array<string>, semantics array<string>")
    models = {n: vectors.word_vectors(t.select(F.col(n).alias("tokens")), 8) for n in ("tokens", "structure", "semantics")}
    got = {r.key: np.array(r.v) for r in relevance.model_cascade(t, models).collect()}
    word = {n: {r.word: np.array(r.vector.toArray()) for r in m.getVectors().collect()} for n, m in models.items()}
    for k, *parts in rows:
        want = sum(w * np.mean([word[n].get(x, np.zeros(8)) for x in p], axis=0) for n, p, w in zip(("tokens", "structure", "semantics"), parts, (0.5, 0.3, 0.2), strict=True))
        assert np.allclose(got[k], want / np.linalg.norm(want), atol=1e-5)
    assert relevance.model_cascade(t, d=32).count() == 12


def test_language_of_paths(spark):
    got = spark.createDataFrame([("a.sc",), ("x/y.MLI",), ("b.unknown",), ("c",)], "p string").select(facts.language("p").alias("l")).collect()
    assert [r.l for r in got] == ["scala", "ocaml", None, None]


def test_shared_folder_is_required_on_a_cluster():
    from tessera.plans import tables

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, k: None
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        tables.shared_dir(Session())
