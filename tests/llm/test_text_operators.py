"""Near duplicates, licenses, decontamination, language, quality, toxicity: brute force and edge cases on small tables."""

import random

import numpy as np
import pytest
from compare import connect, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, license_scan, near_dedup, quality, queries, toxicity
from tessera.llm.common import WordHash, prepare

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "word " * 30_000), (7, "×÷ ß 你好"), (None, "one two three four five six"), (7, "a b c d e f"), (8, "\x00\x01 !!")]


def docs(spark, rows_, more=False):
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    return df.withColumn("rep", F.lit("x")).withColumn("score", F.lit(1)).withColumn("h", F.lit(2)) if more else df


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_groups(rows_, k):
    s = {i: sets(t, k) for i, t in rows_ if i is not None}
    up = {i: i for i in s}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in s:
        for b in s:
            both = len(s[a] & s[b])
            if a < b and both and 100 * both >= 80 * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in s}


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(4000)}" for _ in range(n)] for n in (8, 12, 40, 60, 60, 200)]
    made, i = [], 100
    for b in base:
        for _ in range(14):
            w = list(b)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3, 6))):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            made.append((i, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
            i += 1
    made += [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "b a")]
    for k in (4, 5):
        got = {x.doc_id: (x.component_id, x.n_shingles, x.kept) for x in near_dedup.groups(docs(spark, made), n_words=k).collect()}
        want = brute_groups(made, k)
        assert {d: g[0] for d, g in got.items()} == want
        assert all(g[1] == len(sets(t, k)) for (d, t) in made for g in [got[d]])
        assert all(g[2] == (d == g[0]) for d, g in got.items())


def test_near_duplicates_edge_cases(spark):
    got = near_dedup.groups(docs(spark, EDGE, more=True), n_words=4).collect()
    assert len(got) == len(EDGE)
    by = {(x.doc_id, x.n_shingles): x for x in got}
    assert by[(1, 0)].component_id == 1 and by[(2, 0)].kept and by[(5, 1)].component_id == 4 and not by[(5, 1)].kept
    assert by[(None, 3)].component_id is None and not by[(None, 3)].kept
    assert near_dedup.groups(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.floats(0.3, 1.0), st.integers(0, 10**6))
def test_estimate_is_close(n, j, seed):
    r = np.random.default_rng(seed)
    both = int(n * j)
    pool = r.integers(0, 2**63, n + (n - both), dtype=np.int64).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n:]]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    e = near_dedup.estimate(near_dedup.registers(a).tobytes(), near_dedup.registers(b).tobytes(), len(a), len(b))
    assert abs(e - true) < 0.3


def test_license_scan_equals_sql_and_edges(spark, sf):
    name = "op10_license_scan"
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).execute(queries.ORACLE_SQL[name]).df())
    more = [(10, "Under the MIT license, under the mit License."), (11, "cc by nc" + " x" * 500 + " CC-BY-NC"), (12, "this software and associated documentation files permission is hereby granted free of charge to any person obtaining a copy of the to deal in software without restriction")]
    got = {x.doc_id: x for x in license_scan.scan(docs(spark, EDGE + more, more=True)).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels, got[10].score) == (2, 0, 4, "mit", 1.0)
    assert (got[11].n_base, got[11].first_word, got[11].last_word) == (2, 0, 503)
    assert got[12].base_labels == "" and got[12].labels == "mit" and got[12].score == 1.0
    assert got[1].n_words == 0 and got[1].labels == "" and got[6].n_words == 30_000
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_license_notices_may_be_wrapped_and_long(spark):
    notice = dict(license_scan.templates())
    wrap = lambda t, n=7: "\n * ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    filler = " ".join(f"x{i}" for i in range(1000))
    every = [(100 + i, f"{filler} {wrap(t)}\n{filler}") for i, (_, t) in enumerate(license_scan.templates())]
    short = "this work is licensed under a creative commons attribution 4 0 international license"
    d = [(1, wrap(notice["bsd"])), (2, f"{filler} {wrap(short)}"), (3, "this library is free software"), (4, wrap(" ".join(w for i, w in enumerate(notice["isc"].split()) if i % 9))), (5, " the ".join(f"x{i} of and or" for i in range(500)))]
    found = license_scan.scan(docs(spark, d + every)).collect()
    got, all_ = {x.doc_id: (x.likely_labels, x.score) for x in found}, {x.doc_id: x.labels.split(",") for x in found}
    assert all(set(likely.split(",")) <= set(all_[k]) for k, (likely, _) in got.items())
    assert got[1] == ("bsd", 1.0) and got[2] == ("cc-by", 1.0) and got[3] == ("", 0.0) and got[4][0] == "isc" and got[5] == ("", 0.0)
    for i, (label, _) in enumerate(license_scan.templates()):
        assert label in got[100 + i][0].split(",") and label in all_[100 + i] and got[100 + i][1] == 1.0, (label, got[100 + i])
    v3 = next(t for label, t in license_scan.templates() if label == "gpl-3" and "program" in t)
    one = license_scan.scan(docs(spark, [(1, v3)])).first()
    assert one.likely_labels == "gpl-3" and set(one.labels.split(",")) >= {"gpl-2", "gpl-3"}


def test_license_scan_matches_brute_force(spark):
    r = random.Random(8)
    known = (("a", "one two three four five"), ("b", "one two three four six seven"), ("c", " ".join(f"t{i}" for i in range(40))))
    pool = sorted({w for _, t in known for w in t.split()}) + ["z"] * 20
    d = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(0, 300)))) for i in range(60)] + [(100 + i, " ".join(w for w in known[i % 3][1].split() if r.random() < 0.9)) for i in range(40)]
    kin = license_scan.families(known)
    want, whole = {}, {}
    for i, t in d:
        w, best = t.split(), {}
        for n in {n for _, n in kin}:
            for at in range(0, max(-(-(len(w) - n) // (n // 2)), 0) * (n // 2) + 1, n // 2):
                block = set(w[at : at + n])
                for (label, x), (family, length) in zip(known, kin, strict=True):
                    own = set(x.split())
                    if length == n and len(own & block) >= license_scan.needed(x):
                        best.setdefault((n, at, family), []).append((len(own & block) / len(own), len(own), label))
        want[i] = ",".join(sorted({label for rows_ in best.values() for *x, label in rows_ if x == list(max(rows_)[:2])}))
        whole[i] = ",".join(sorted({label for rows_ in best.values() for *_, label in rows_}))
    got = license_scan.scan(docs(spark, d), known=known).collect()
    assert {x.doc_id: x.labels for x in got} == whole and {x.doc_id: x.likely_labels for x in got} == want
    assert len({*want.values()}) > 3 and whole != want


def test_decontamination(spark):
    prepare(spark)
    item = "Yesterday Tom bought 3 apples and 4.5 kg of pears while Ann paid 3 dollars at the corner shop near Paris."
    short = "seven words are all that it has"
    d = [
        (20, "x y z " + item + " more text"), (21, "so then Lisa bought 7 apples and 9,5 kg of pears while Bob paid 7 dollars at the corner shop near Rome. ok"),
        (22, "so then Lisa bought 7 apples and 9,5 kg of pears while Bob paid 8 dollars at the corner shop near Rome. ok"), (23, "a clean text of its own that holds nothing of the kind at all, not even 3 dollars"), (24, "Well, SEVEN words are all, that it has!"),
    ]
    items = spark.createDataFrame([(1, item), (2, short), (3, None), (4, ""), (2, short)], "item_id int, text string")
    got = {(x.doc_id, x.item_id): x.exact for x in decontaminate.find(docs(spark, EDGE + d, more=True), items).collect()}
    assert got == {(20, 1): True, (21, 1): False, (24, 2): True}
    same = decontaminate.find(docs(spark, EDGE + d), items, broadcast_windows=0).collect()
    assert {(x.doc_id, x.item_id): x.exact for x in same} == got
    assert decontaminate.find(docs(spark, []), items).count() == 0 and decontaminate.find(docs(spark, d), items.limit(0)).count() == 0


def test_decontamination_checks_slots_window_by_window(spark):
    prepare(spark)
    twice = "the clerk sold 3 red pencils to the old teacher who lived on the hill above the harbour with a small dog and then the baker brought 3 loaves of fresh bread to the same house"
    asked = "a farmer had 3 apples in one basket and then 5 pears in another, how many were there at noon"
    unit = "the road is 3 km long and the river is 2 miles long so the walk is shorter than the swim"
    items = spark.createDataFrame([(1, twice), (2, asked), (3, unit)], "item_id int, text string")
    d = [
        (1, twice.replace("3 loaves", "9 loaves")), (2, asked.replace("3 apples", "4 apples").replace("5 pears", "4 pears")), (3, unit.replace("3 km", "5 km").replace("2 miles", "4 km")),
        (4, twice.replace("3 red", "8 red").replace("3 loaves", "9 loaves")), (5, "the road is 3 km long and nothing else is like it in any other way at all"),
    ]
    got = {(x.doc_id, x.item_id): (x.exact, x.n_found, x.n_windows) for x in decontaminate.find(docs(spark, d), items, coverage=0.2).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 1): False, (2, 2): False, (3, 3): False, (4, 1): False}
    assert all(got[k][1] == got[k][2] for k in ((1, 1), (2, 2), (3, 3)))
    assert got[(4, 1)][1] == got[(4, 1)][2] - 12  # windows 0 to 3 hold the first 3, eight more the second
    assert decontaminate.find(docs(spark, d[3:]), items, coverage=0.9).count() == 0


def test_decontamination_matches_brute_force(spark, sf):
    con = connect(sf)
    whole = set(con.execute("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op7_decontamination"](spark, sf).collect()}
    assert whole <= got


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(2)
    lengths = [0, 1, 5, 3, 9, 0, 2]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    s = (r.random((len(owner), 3)) * -6).astype(np.float32)
    got = language_id.viterbi(s, owner, len(lengths), 4.0)
    worth = lambda path, x: sum(x[i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for t in range(len(lengths)):
        x = s[owner == t]
        if len(x):
            best = max(worth(p, x) for p in np.stack(np.meshgrid(*[range(3)] * len(x)), -1).reshape(-1, len(x)))
            assert abs(worth(got[owner == t].tolist(), x) - best) < 1e-4


def test_language_spans_and_edges(spark, sf):
    prepare(spark)
    train = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    model = language_id.fit(train)
    en, fr = (train.where(F.col("lang") == x).orderBy(F.length("text").desc()).first().text[:600] for x in ("en", "fr"))
    d = docs(spark, EDGE + [(30, en + " " + fr), (31, "1234 !!"), (32, "привет мир")], more=True)
    got = {(x.doc_id, x.lang_pred): x for x in language_id.detect(d, model).collect()}
    assert {s.lang for s in got[(30, next(p for i, p in got if i == 30))].spans} == {"en", "fr"}
    assert (1, "und") in got and (31, "und") in got and (8, "und") in got and got[(31, "und")].score == 0
    assert language_id.detect(docs(spark, []), model).count() == 0
    assert {x.lang_pred for x in language_id.detect(docs(spark, EDGE), language_id.fit(train.limit(0))).collect()} == {"und"}


def test_long_texts_are_labelled_like_short_ones(spark, sf):
    prepare(spark)
    train = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang")
    model = language_id.fit(train)
    rows_ = train.collect()
    texts = [r.text for r in rows_[:40]] + ["", "12 3", " ".join(r.text for r in rows_[:12]), "x" * 9000]
    (_, every, _, owner_), *more = language_id.labelled(texts, model, 1 << 30)
    whole = [every[owner_ == t] for t in range(len(texts))]
    assert not more
    for size in (300, 5000):
        got = {}
        for at, labels, sizes, owner in language_id.labelled(texts, model, size):
            for t in np.unique(owner):
                got[at + int(t)] = (labels[owner == t], sizes[owner == t])
        for t in range(len(texts) - 1):
            assert np.array_equal(got.get(t, (np.zeros(0),))[0], whole[t]), (size, t)
        assert got[len(texts) - 1][1].sum() == 9000
    assert all("".join(language_id.pieces(t, 300)) == t and max(map(len, language_id.pieces(t, 300)), default=0) <= 300 for t in texts)


def test_more_languages_than_a_byte_counts(spark):
    prepare(spark)
    r = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words_ = {f"l{i:03}": ["".join(r.choice(alphabet) for _ in range(6)) for _ in range(30)] for i in range(300)}
    say = lambda k, n: " ".join(r.choice(words_[k]) for _ in range(n))
    train = spark.createDataFrame([(say(k, 200), k) for k in words_] + [(None, "l000"), ("x", None)], "text string, lang string")
    model = language_id.fit(train)
    asked = [(i, say(k, 40)) for i, k in enumerate(words_)] + [(400, "\U00032010\U00032011"), (401, None)]
    got = {x.doc_id: x for x in language_id.detect(docs(spark, asked), model, spans=False).collect()}
    assert len(model.langs) == 300 and sum(got[i].lang_pred == k for i, k in enumerate(words_)) >= 295
    assert got[400].lang_pred != "und" and got[401].lang_pred == "und"


def test_language_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op8_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_quality_resampling(spark, sf):
    got = queries.QUERIES["op2_quality_resampling"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n = {(r.quality, r.sampled): r["count"] for r in got.groupBy("quality", "sampled").count().collect()}
    assert n[(1, True)] >= 0.98 * (n[(1, True)] + n.get((1, False), 0)) and n[(0, False)] >= 0.9 * (n[(0, False)] + n.get((0, True), 0))
    labels = spark.createDataFrame([(4, 1), (5, None)], "doc_id long, quality int")
    assert quality.resample(docs(spark, EDGE, more=True), labels).where("sampled").count() == len(EDGE)
    assert quality.resample(docs(spark, []), labels).count() == 0


def test_quality_weights_match_brute_force(spark, sf):
    con = connect(sf)
    d, labels = con.execute("select doc_id, text from documents").fetchall(), dict(con.execute("select doc_id, quality from labels").fetchall())
    hashes = WordHash()
    counts = {}
    for kind, some in (("target", [t for i, t in d if labels.get(i) == 1]), ("raw", [t for _, t in d])):
        counts[kind] = np.zeros(quality.SIZE)
        for t in some:
            for g in quality.ngrams(t.encode(), hashes):
                counts[kind][g] += 1
    p = {k: (c + 0.5) / (c.sum() + 0.5 * quality.SIZE) for k, c in counts.items()}
    got = {x.doc_id: x for x in queries.QUERIES["op2_quality_resampling"](spark, sf).collect()}
    for i, t in d:
        grams = quality.ngrams(t.encode(), hashes)
        assert got[i].n_grams == len(grams)
        assert abs(got[i].log_weight - sum(np.log(p["target"][g] / p["raw"][g]) for g in grams)) < 1e-6
    k = round(sum(labels.values()) / len(labels) * len(d))
    assert {i for i, x in got.items() if x.sampled} == set(sorted(got, key=lambda i: (-got[i].noisy_weight, i))[:k])


def test_words_in_capitals_and_said_twice_are_ngrams_of_their_kind():
    grams = lambda t: sorted(quality.ngrams(t, WordHash()).tolist())
    assert len(grams(b"One two")) == 3 and len(grams(b"ONE two")) == 4 and len(grams(b"one One")) == 4 and len(grams(b"")) == 0
    assert len(set(grams(b"AAA b")) & set(grams(b"CCC d"))) == 1


def test_gumbel_top_k_draws_in_proportion_to_the_weights(spark):
    n = 4000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    from tessera.llm.common import uniform

    w = F.when(F.col("doc_id") % 2 == 0, F.lit(np.log(3.0))).otherwise(0.0)
    noisy = d.withColumn("s", w - F.log(-F.log(uniform("doc_id", 11))))
    some = quality.top_k(noisy, "s", "doc_id", 400).where("sampled")
    share = some.where("doc_id % 2 = 0").count() / some.count()
    assert some.count() == 400 and 0.68 < share < 0.82


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100, 200])
def test_top_k(spark, k):
    df = spark.createDataFrame([(i, float(i * 7919 % 20)) for i in range(100)], "key int, s double").cache()
    want = {r.key for r in sorted(df.collect(), key=lambda r: (-r.s, r.key))[:k]}
    for small in (1, 20_000):
        assert {r.key for r in quality.top_k(df, "s", "key", k, small).where("sampled").collect()} == want


def test_top_k_with_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, 1.0)] * 30 + [(5, 1.0)] * 10 + [(3, 1.0), (9, 2.0), (8, 0.0), (None, 0.0)], "key int, s double").cache()
    for k in (1, 2, 8, 13, 30, 42, 43):
        for small in (1, 20_000):
            got = quality.top_k(df, "s", "key", k, small).collect()
            kept = [r for r in got if r.sampled]
            assert len(got) == 44 and len(kept) == k and all(r.sampled is not None for r in got)
            assert sorted((-r.s, r.key is None, r.key or 0) for r in kept) == sorted((-r.s, r.key is None, r.key or 0) for r in got)[:k]


def test_toxicity_held_out_and_edges(spark, sf):
    got = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    d = docs(spark, EDGE, more=True)
    none = toxicity.fit(d, spark.createDataFrame([(4, None)], "doc_id long, toxic int"))
    assert {x.score for x in toxicity.score(d, none).collect()} == {0.0}
    two = toxicity.fit(d, spark.createDataFrame([(4, 1), (6, 0), (2, 0), (4, 0)], "doc_id long, toxic int"))
    assert all(0 <= x.score <= 1 for x in toxicity.score(d, two).collect())
    assert toxicity.score(docs(spark, []), two).count() == 0
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {})
    f = dict(zip(toxicity.NAMES, toxicity.features("You are an 1d10t!", lexicon), strict=True))
    assert f["hits"] == 1 and f["near_second_person"] == 1 and f["obfuscated"] > 0


def naive_features(text, words_, stems):
    """The same features counted plainly, word by word."""
    import re

    found = re.findall(r"[^\W_]+(?:[@$*.'\u2019_-][^\W_]+)*", text)
    n, size = max(len(found), 1), max(len(text), 1)
    bare = []
    for w in found:
        w = w.lower()
        if not w.isalpha() and not w.isdigit():
            w = "".join(c for c in "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.get(c, c) for c in w) if c.isalnum())
        bare.append(w)
    hits = [words_.get(w, 0.0) for w in bare]
    begins = [max([0.0, *(stems.get(w[:k], 0.0) for k in (4, 5, 6) if len(w) >= k)]) for w in bare]
    odd = [b != w.lower() and any(c.isalpha() for c in w) and any(c.isdigit() or c in "@$*" for c in w) for b, w in zip(bare, found, strict=True)]
    second = [w.lower() in toxicity.SECOND_PERSON for w in found]
    marks = [i for i in range(len(found)) if hits[i]] or [i for i in range(len(found)) if begins[i]]
    near = sum(any(second[max(i - 5, 0) : i + 6]) for i in marks)
    letters = sum(c.isalpha() for c in text)
    return [
        sum(h > 0 for h in hits), sum(h > 0 for h in hits) / n, sum(hits) / n, max(hits, default=0), sum(b > 0 for b in begins), sum(b > 0 for b in begins) / n, sum(begins) / n, max(begins, default=0), near / max(len(marks), 1),
        sum(second) / n, sum("A" <= c <= "Z" for c in text) / max(letters, 1), sum(len(w) > 2 and w.isupper() for w in found) / n, text.count("!") / size, sum(c in "!?.,;:*#$%&|" for c in text) / size, sum(odd) / n, len(re.findall(r"(\w)\1\1", text)) / n, np.log(1 + len(found)),
    ]


def test_toxicity_features_match_a_plain_count(spark, sf):
    lexicon = toxicity.Lexicon({"idiot": 4.0, "fool": 2.5}, {"scum": 3.0, "thath": 2.0})
    texts = [r[0] for r in connect(sf).execute("select text from documents where length(text) < 4000").fetchall()] + [t or "" for _, t in EDGE] + ["You 1d10t!! SCUMMY f@@l, YOU fooool", "tu eres un fool. " * 40]
    for t in texts:
        assert np.allclose(toxicity.features(t, lexicon), naive_features(t, lexicon.words, lexicon.stems)), t[:80]


def test_trees_split_where_an_exhaustive_search_does_and_score_as_walked():
    r = np.random.default_rng(9)
    x = np.round(r.random((300, 3)) * 8)
    y = ((x[:, 1] > 4) ^ (r.random(300) < 0.1)).astype(int)
    t = toxicity.boost(x, y, trees=5, ridge=3.0)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = y - p, np.full(300, p * (1 - p))
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 3) + g[~m].sum() ** 2 / (h[~m].sum() + 3)
    best = max((worth(x[:, j] <= v), j, v) for j in range(3) for v in np.unique(x[:, j])[:-1])
    j, edge = int(t.feature[0][0]), t.edges[int(t.feature[0][0])][t.cut[0][0]]
    assert abs(worth(x[:, j] <= edge) - best[0]) < 1e-9
    for row, raw in zip(x[:50], t.raw(x[:50]), strict=True):
        total = t.start
        for f, c, leaf in zip(t.feature, t.cut, t.leaf, strict=True):
            node = 0
            for _ in range(3):
                e = t.edges[f[node]]
                node = 2 * node + (2 if sum(v < row[f[node]] for v in e) > c[node] else 1)
            total += leaf[node - 7]
        assert abs(total - raw) < 1e-9


def test_isotonic_matches_min_max_of_means():
    r = np.random.default_rng(5)
    x = np.sort(r.normal(size=60))
    y = (r.random(60) < 1 / (1 + np.exp(-2 * x))).astype(int)
    v = np.concatenate([[0.0], y, [1.0]])
    fit = [max(min(v[a : b + 1].mean() for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    at, p = toxicity.isotonic(x, y)
    assert np.allclose(np.unique(np.round(p, 9)), np.unique(np.round(fit, 9))) and (np.diff(at) >= 0).all()


def test_toxicity_lexicon_is_bounded_by_its_parameter(spark, sf):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    few = toxicity.fit(d, labels, lexicon_bound=3)
    assert len(few.words) - len(toxicity.SEED_WORDS) + len(few.stems) <= 3


def test_isotonic_rises():
    r = np.random.default_rng(3)
    x = r.normal(size=500)
    _, p = toxicity.isotonic(x, (r.random(500) < 1 / (1 + np.exp(-2 * x))).astype(int))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_word_split_is_the_contract():
    import re

    from tessera.llm.common import words_of

    t = "A\x0bb\x0cC\xa0d é É \x1c x\x85y"
    assert [w.decode() for w in words_of(t.encode())] == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert len(set(WordHash().of([b"a", b"b", b"a"]).tolist())) == 2


def test_near_duplicates_equal_sql(spark, sf):
    name = "op1_near_dedup"
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).execute(queries.ORACLE_SQL[name]).df())
