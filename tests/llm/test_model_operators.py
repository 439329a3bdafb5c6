"""Language-model scores, mixing, nearest neighbours, HTML, the pipeline."""

import math
import random
from collections import Counter

import numpy as np
from compare import connect
from pyspark.sql import functions as F

from tessera.llm import ann, html_extract, lm_score, mixing, queries
from tessera.llm.common import fold, prepare


def test_lm_scores(spark, sf):
    got = queries.QUERIES["op5_lm_score"](spark, sf).toPandas()
    docs = connect(sf).execute("select doc_id, text from documents").fetchall()
    held = dict(zip(got.doc_id, got.held_out, strict=True))
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in docs}
    c = Counter(w for i, ts in tokens.items() if not held[i] for w in ts)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        ts = tokens[r.doc_id]
        assert r.n_tokens == len(ts) and r.n_known == sum(w in c for w in ts) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts), rel_tol=1e-9)
    out = got[got.held_out]
    assert (got.score <= 0).all() and out.score.sum() > out.base_score.sum()


def test_lm_model_matches_brute_force_but_for_false_positives(spark, sf):
    got = queries.QUERIES["op5_lm_score"](spark, sf).toPandas().set_index("doc_id")
    docs = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in connect(sf).execute("select doc_id, text from documents").fetchall()}
    train = [ts for i, ts in docs.items() if not got.held_out[i]]
    level = lambda n, of: int(of[np.searchsorted(of, n, side="right") - 1]) if n else 0
    c = Counter(w for ts in train for w in ts)
    n, v = sum(c.values()), len(c)
    rough = {w: level(k, lm_score.UNIGRAM_LEVELS) for w, k in c.items()}
    cls = lambda w: int(lm_score.frequency_class(np.array([rough.get(w, 0)]))[0])
    pairs = Counter((a, b) for ts in train for a, b in zip([b"\n", *ts], ts, strict=False))
    cells = Counter(int(lm_score._count_class(np.array([k]))[0]) << 10 | cls(a) << 5 | cls(b) for (a, b), k in pairs.items())
    lam = lm_score._fit_lam(np.array(list(cells)), np.array(list(cells.values())), n, v)
    off = []
    for i, ts in docs.items():
        total = 0.0
        for a, b in zip([b"\n", *ts], ts, strict=False):
            before = rough.get(a, 0)
            seen = min(level(pairs.get((a, b), 0), lm_score.BIGRAM_LEVELS), before, rough.get(b, 0))
            total += math.log10(lam[cls(a)] * seen / max(before, 1) + (1 - lam[cls(a)]) * (rough.get(b, 0) + 1) / (n + v + 1))
        off.append((got.score[i] - total) / -total)
    # false positives of the filters also reach the weights of all classes a little
    assert np.mean(np.abs(off)) < 0.005 and np.quantile(np.abs(off), 0.95) < 0.015 and max(np.abs(off)) < 0.1


def test_lm_edges(spark):
    prepare(spark)
    rows = [(1, None), (2, ""), (3, "a b a b"), (None, "a"), (3, "a b a b"), (4, "z " * 5000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("train", F.lit("x"))
    got = lm_score.score(d, fold("doc_id", 7) != 99).collect()
    assert len(got) == 6 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1}
    assert lm_score.score(d.limit(0), F.lit(True)).count() == 0
    small = lm_score.score(d, F.lit(True), max_filter_bytes=8).collect()
    assert all(r.score < 0 and r.n_known == r.n_tokens for r in small)
    none = lm_score.score(d, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in none)


def test_lm_keeps_bigrams_seen_once_under_any_bound(spark):
    prepare(spark)
    often = [(i, f"v{i % 200} w{i % 200}") for i in range(600)]
    once = [(1000 + i, f"v{i} x{i}") for i in range(200)]
    asked = [(2000 + i, f"v{i} x{i}") for i in range(200)] + [(3000 + i, f"v{i} x{(i + 1) % 200}") for i in range(200)]
    d = spark.createDataFrame(often + once + asked, "doc_id long, text string")
    for bound in (lm_score.MAX_FILTER_BYTES, 64):
        got = {r.doc_id: r.score for r in lm_score.score(d, F.col("doc_id") < 2000, max_filter_bytes=bound).collect()}
        seen, unseen = sum(got[2000 + i] for i in range(200)), sum(got[3000 + i] for i in range(200))
        assert seen > unseen + 50, (bound, seen, unseen)


def test_filter_counts_never_exceed_but_for_false_positives():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 20_000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    counts = np.maximum(1, r.pareto(0.7, len(keys)) * 2).astype(np.int64)
    parts = {i: lm_score.segment(keys[s], counts[s], lm_score.levels(1.05, 1)) for i, s in lm_score._slices(keys, 8)}
    f = lm_score._filter(parts, 8, lm_score.levels(1.05, 1))
    got = f.counts(keys)
    assert (got * 1.0 >= counts / 1.12 - 1).all() and (got > counts).mean() < 0.02
    assert (f.counts(keys + np.uint64(1)) > 0).mean() < 0.02


def fill(sizes, weights, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    w, full = {n: weights[i % 3] for i, n in enumerate(names)}, set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[n] for n in full)
        total = sum(w[n] for n in names if n not in full)
        t = {n: most * sizes[n] if n in full else rest * w[n] / total for n in names}
        new = {n for n in names if n not in full and t[n] > most * sizes[n]}
        if not new:
            return t
        full |= new


def test_mixing(spark, sf):
    got = queries.QUERIES["op6_source_mixing"](spark, sf).toPandas()
    again = queries.QUERIES["op6_source_mixing"](spark, sf).toPandas()
    assert dict(zip(got.doc_id, got.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    want = fill(per["size"].to_dict(), (5, 2, 1))
    assert all(math.isclose(per.target[n], want[n], rel_tol=1e-9) for n in want)
    assert (abs(per.taken - per.target) <= 0.02 * per.target + 30).all() and (got.taken <= 2 * got["size"]).all()


def test_mixing_many_blocks_and_edges(spark):
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 3}" if i % 4 else "hot") for i in range(3000)] + [(1, None, None), (None, "a b", None), (5, "", "z"), (5, "", "z"), (6, "q q", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("h", F.lit("x"))
    got = mixing.mix(d, block=64).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), n=("copies", "sum"), rows=("copies", "count"))
    big = per[per["size"] > 1000]
    assert (abs(big.taken - big.target) <= 0.01 * big.target + 40).all()
    assert (abs(big.n - big.rows * big.target / big["size"]) <= 8).all()
    assert mixing.mix(d.limit(0)).count() == 0


def test_mixing_deals_a_repeated_key_out(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") < 60_000, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("hot").alias("source"))
    rows = rows.union(spark.createDataFrame([(i, "a b", f"s{i % 5}") for i in range(500)], "doc_id long, text string, source string"))
    got = mixing.mix(rows).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).toPandas()
    hot = got[got.source == "hot"]
    assert hot.n.sum() == 100_000 and abs(hot.taken.sum() - hot.target.iloc[0]) <= 60
    assert abs(hot.taken / hot.n - hot.taken.sum() / 100_000).max() < 0.05
    sized = rows.select(F.col("doc_id").alias("key"), "source", F.lit(3).alias("size"))
    copies = mixing._counted(sized).where("source = 'hot'").groupBy("key").agg(F.count_distinct("copy").alias("n"), F.max("copy").alias("last")).collect()
    assert {(r.n, r["last"]) for r in copies} == {(60_000, 59_999), (40_000, 39_999)}


def test_lm_score_deals_a_repeated_key_out(spark):
    prepare(spark)
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 50).cast("string"), F.lit(" x y")).alias("text"))
    rows = rows.union(spark.createDataFrame([(100 + i, f"w{i} x") for i in range(200)], "doc_id long, text string"))
    chunked = lm_score._chunked(rows, "doc_id", "text", F.lit(True), 8, 20_000)
    assert chunked.count() == 20_200 and chunked.groupBy("chunk").agg(F.sum(F.length("text") + 16).alias("n")).agg(F.max("n")).first()[0] < 60_000
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.base_score, 9), round(r.score, 6))
    train = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    whole, small = (sorted(map(key, lm_score.score(rows, train, chunk_bytes=n).collect())) for n in (4 << 20, 20_000))
    assert whole == small and len(whole) == 20_200


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    return {(int(q), r + 1): int(ids[j]) for n, q in enumerate(ids) if q % every == 0 for r, j in enumerate([j for j in np.lexsort((ids, -(x * x[n]).sum(1))) if j != n][:k])}


def test_nearest_neighbours(spark, sf):
    rows = [(r[0], list(map(float, r[1]))) for r in connect(sf).execute("select vec_id, embedding from embeddings").fetchall()]
    want = brute(rows, 20, 20)
    got = {(r.query_id, r.rank): r.vec_id for r in queries.QUERIES["op4_nearest_neighbours"](spark, sf).collect()}
    hits = sum(len({v for (q, _), v in want.items() if q == a} & {v for (q, _), v in got.items() if q == a}) for a in {q for q, _ in want})
    assert len(got) == len(want) and hits >= 0.9 * len(want)


def test_nearest_neighbours_over_many_shards_and_blocks(spark):
    prepare(spark)
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 8)).round(2)
    x[100:400] = x[0]  # one very common vector
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([(i, v.tolist()) for i, v in enumerate(x)], 5, 3)
    for shard, block in ((40, 7), (64, 10**6)):
        got = {(q.query_id, q.rank): (q.vec_id, q.score) for q in ann.search(d, F.col("vec_id") % 3 == 0, k=5, recall=1.0, centroids=6, shard=shard, query_block=block).collect()}
        assert len(got) == len(want) and sum(got[k][0] == v for k, v in want.items()) >= 0.98 * len(want)
        assert all(abs(s - float((x[q] * x[v]).sum())) < 1e-9 for (q, _), (v, s) in got.items())
    assert ann.search(d, F.lit(False)).count() == 0
    assert ann.centroids_for(10**4) < ann.centroids_for(10**6) <= ann.MOST_CENTROIDS and ann.shard_for(10**9) == ann.MOST_SHARD


def test_nearest_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (20, [0.0, 0.0, 0.0]), (40, None), (60, [1.0, None, 2.0]), (80, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (100, [1.0, 2.0]), *[(i, [1.0, 1.0, 0.0]) for i in range(1, 15)], (16, [2.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(d, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == [(0, 1, 16, 2.0), *[(0, r + 1, r, 1.0) for r in range(1, 5)]]
    assert ann.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_html(spark, sf):
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="cookie-notice">We use</div><div class="post-12 content"><h2>T &amp; U&nbsp;</h2>
    <p>First   para<br>line.<p>Second <a href=z>link</a> text that is long enough<!-- c --><script>if (a < b) x("</p>")</script></p><div class=advert>buy</div><ul><li>a<li>b</ul><form>q<input></form></div><div class="comments"><p>Reader comment that is much longer than the text of the article itself, by far and wide, and says little.</p></div><footer>c</footer></body>"""
    got = html_extract.extract(page, None)
    assert got == "T & U\n\nFirst para line.\n\nSecond link text that is long enough\n\na\n\nb"
    rows = [(1, "http://a/1", page), (2, None, None), (3, "", ""), (4, "http://a/2", "<p>only text"), (5, "http://a/1", page), (6, "x", "no tags &lt;b&gt;"), (7, "http://a/3", "<article><p>unclosed"), (8, "http://b/", "<div>" * 300 + "deep" + "</div>" * 300)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).withColumn("path", F.lit(3))
    out = {r.page_id: r for r in html_extract.main_text(d).collect()}
    assert out[1].text == out[5].text == got and out[1].n_chars == len(got) and out[2].text == "" and out[3].n_chars == 0
    assert out[4].text == "only text" and out[6].text == "no tags <b>" and out[7].text == "unclosed" and out[8].text == "deep"
    assert html_extract.main_text(d.limit(0)).count() == 0


BAD_BLOCKS = ["<nav><ul><li><a href=/>{}</a></ul></nav>", "<div class=ad>{}</div>", "<aside>{}</aside>", "<div class='site-footer x'>{}</div>", "<form>{}<input></form>", "<div id=cookie-notice>{}</div>", "<script>{}</script>", "<div hidden>{}</div>", "<div role=navigation>{}</div>", "<section class=comments><p>{}</p></section>", "<!-- {} -->", "<footer>{}</footer>", "<div style='display: none'>{}</div>"]


def made_page(r, shape):
    """A page of a known article among other parts, and the article's blocks."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma &amp; x", "d\u00e9j\u00e0", "<b>bold</b>", "a<br>b", "<a href=x>link</a> and"]) for _ in range(n))
    clean = lambda t: " ".join(t.replace("<br>", " ").replace("&amp;", "&").replace("<b>", "").replace("</b>", "").replace("<a href=x>", "").replace("</a>", "").split())
    noise = lambda: "".join(r.choice(BAD_BLOCKS).format("nothing " * r.randrange(1, 60)) for _ in range(r.randrange(3)))
    texts = [words(r.choice((1, 4, 30, 120))) for _ in range(r.randrange(2, 7))]
    part = lambda t: r.choice(("<p>{}</p>", "<h2>{}</h2>", "<p>{}", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>")).format(t)
    if shape == "sections":
        body = "".join(f"<section class=s><p>{t}</p>{noise()}</section>" for t in texts)
    else:
        opening, closing = {"article": ("<article title='The hidden nav'>", "</article>"), "main": ("<main data-hidden=false>", "</main>"), "named": ("<div class='related-work content'>", "</div>")}[shape]
        body = opening + "".join(part(t) + noise() for t in texts) + closing
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{noise()}<header><p>Site</p></header>{body}{noise()}<footer>f</footer></body></html>", [clean(t) for t in texts]


def test_made_pages_give_their_article_whole(spark):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(400):
        shape = r.choice(("article", "main", "named", "sections"))
        html, texts = made_page(r, shape)
        rows.append((i, f"http://{shape}.example/{i}", html))
        want[i] = "\n\n".join(texts)
        assert html_extract.extract(html, None) == want[i], html
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x for x in html_extract.main_text(d).collect()}
    assert {i: x.text for i, x in got.items()} == want and all(x.n_chars == len(x.text) for x in got.values())
    shuffled = html_extract.main_text(d, broadcast_hosts=0)
    assert {x.page_id: x.text for x in shuffled.collect()} == want


def test_attributes_names_and_short_parts():
    of = lambda html: html_extract.extract(html, None)
    long = "long text " * 60
    assert of(f"<body><section class=s><p>{long}</p></section><section class=s><p>The end.</p></section></body>").endswith("\n\nThe end.")
    assert of("<article title='The hidden truth'><p>x</p></article>") == of("<article data-hidden='false'><p>x</p></article>") == of("<div class='related-work article'><p>x</p></div>") == "x"
    assert of("<form><p>whole page in a form</p></form>") == "whole page in a form" and of("<div class=notice><p>all there is</p></div>") == "all there is"
    assert of("<div class=content-sidebar-wrap><main><p>m</p></main><div class=sidebar>s</div></div>") == "m"
    assert of("<nav>menu</nav><div class=ad>buy</div><article></article>") == "" and of("<p title='a > b'>5 < 6</p>") == "5 < 6"


def test_votes_follow_the_pages_of_a_host(spark):
    page = lambda n, extra="": f"<body><div class=box><p>{'word ' * n}</p></div><div class=side>{extra}</div></body>"
    odd = f"<body><div class=box><p>short but the article</p></div><div class=side><p>{'long talk ' * 40}</p></div></body>"
    rows = [(i, "http://a.example/x", page(50)) for i in range(5)] + [(9, "HTTP://u@A.example:80/y", odd), (10, "http://b.example/", odd)]
    got = {x.page_id: x for x in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].text == "short but the article" and got[9].host == "a.example" and got[9].path == "/body/div.box"
    assert got[10].text.startswith("long talk")


def test_deep_and_broken_pages_take_linear_time_and_memory():
    import time
    import tracemalloc

    assert html_extract.extract("<div>" * 100_000 + "deep" + "</div>" * 100_000, None) == "deep"
    tracemalloc.start()
    html_extract.read("<div>" * 20_000 + "deep")
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    for part in ("<nav>x", "<a ", "<a \"'>", "<p class=\"x>", "<div class=ad>x", "<blockquote>x</p>", "<!"):
        start = time.time()
        html_extract.read(part * 40_000)
        assert time.time() - start < 10, part


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, sf))
        assert 0 < out.count() <= docs.count()
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out


def test_pipeline_stages_decide_what_their_operators_say(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, ids = dict(c.STAGES), lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = {n: ids(stages[n](spark, docs, sf)) for n in ("quality", "language", "near_dedup", "decontamination")}
    q = queries.QUERIES
    assert kept["quality"] == ids(q["op2_quality_resampling"](spark, sf).where("sampled"))
    assert kept["decontamination"] == ids(docs) - ids(q["op7_decontamination"](spark, sf))
    texts = {r.doc_id: r.text for r in docs.collect()}
    shingles = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := t.encode().lower().split()) else set() for i, t in texts.items()}
    linked = {(a, b) for a in texts for b in texts if a < b and (both := len(shingles[a] & shingles[b])) and 100 * both >= 80 * len(shingles[a] | shingles[b])}
    up = {i: i for i in texts}
    for a, b in sorted(linked):
        lo, hi = sorted((up[a], up[b]))
        up = {k: lo if v == hi else v for k, v in up.items()}
    assert kept["near_dedup"] == {i for i, v in up.items() if i == v}
    assert len(kept["language"]) > 0.9 * len(texts)


def test_pipeline_with_odd_rows(spark, sf):
    import corpus_pipeline as c

    stages = dict(c.STAGES)
    clean = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    some = [tuple(r) for r in clean.orderBy("doc_id").limit(20).collect()]
    fresh = "a text of its own that stands here five or six times over with nothing else"
    rows = some + [(None, None, None, None, None), (None, "", "en", "web", 0), (None, item, "en", None, 9), (None, fresh, "en", "web", 1), (7_000, fresh, "en", "web", 1), (7_000, fresh, "en", "web", 1), (7_000, "two rows have this key and other words than that one has", "en", "web", 1), (7_001, "word " * 100_000, "en", "x", 1)]
    docs = spark.createDataFrame(rows, clean.schema).withColumn("number", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("key", F.lit(2)).withColumn("h", F.lit(None).cast("string"))
    for name, stage in c.STAGES:
        out = stage(spark, docs, sf).collect()
        assert 0 < len(out) <= len(rows), name
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and (name == "mixing" or none.columns == c.COLUMNS)
        if name == "mixing":
            assert len(out) == len(rows) and all(r.taken <= 2 * r["size"] for r in out)
    left = stages["decontamination"](spark, docs, sf).collect()
    assert item not in {r.text for r in left} and len(left) >= len(rows) - 5
    once = stages["near_dedup"](spark, docs, sf).where(F.col("text") == fresh).collect()
    assert [r.doc_id for r in once] == [7_000]
    assert stages["near_dedup"](spark, docs, sf).where("doc_id = 7000").count() == 2
    assert stages["near_dedup"](spark, docs, sf).where("text is null or text = ''").count() == 2
