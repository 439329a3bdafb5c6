"""Decontamination against a brute-force version: every window of every item against every window of every document."""

import random
from functools import cache

import regex
from compare import connect
from pyspark.sql import functions as F

from tessera.llm import decontaminate, queries
from tessera.llm.common import prepare

NUMBER = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(\p{{Nd}}+(?:[.,]\p{{Nd}}+)*)(?:[ \t]?({decontaminate.UNITS})(?![\p{{L}}\p{{N}}]))?")
NAME = regex.compile(r"(?<=[\p{Ll}\p{Nd},;] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])")
WORD = regex.compile(r"[\p{L}\p{N}\p{M}.,-]+(?:[\p{L}\p{N}\p{M}.,%]*)?")


@cache
def tokens(text):
    """(kind or word, value) of each canonical token."""
    marked = NAME.sub(lambda m: f" {m[1]} ", text or "")
    marked = NUMBER.sub(lambda m: f" {m[1]} {m[2] or ''} ", marked).lower()
    out = []
    for w in regex.split(r"[^\p{L}\p{N}\p{M}-.,]+|(?<!\p{Nd})[.,]+|[.,]+(?!\p{Nd})", marked):
        if w:
            kind, _, value = w.partition("")
            out.append((kind, value if kind in "" else None))
    return out


def brute(docs, items, coverage=0.5):
    found = {}
    for item in {i for i, _ in items if i is not None}:
        text = min((t for i, t in items if i == item and t is not None), default="")
        it = tokens(text)
        k = min(len(it), 8)
        if not k:
            continue
        heavy = lambda w: 2 * sum(v is None for _, v in w) < len(w)
        canon = lambda w: tuple(w) if heavy(w) else tuple(x for x, _ in w)
        windows = {}
        for pos in range(len(it) - k + 1):
            windows.setdefault((heavy(it[pos : pos + k]), canon(it[pos : pos + k])), []).append((pos, it[pos : pos + k]))
        wid = {x: n for n, x in enumerate(windows)}
        rows = [(wid[x], pos, w) for x, places in windows.items() for pos, w in places]
        first = regex.match(r"[^\p{L}\p{N}]*(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", text)
        if first and it[0] == (first[1].lower(), None):
            rows.append((wid[heavy(it[:k]), canon(it[:k])], 0, [("", first[1].lower()), *it[1:k]]))
        by = {}
        for row in rows:
            by.setdefault((heavy(row[2]), canon(row[2])), []).append(row)
        for doc in {d for d, _ in docs if d is not None}:
            equal, met, moved, values = set(), set(), [], {}
            for text in [t for d, t in docs if d == doc]:
                tok = tokens(text)
                for at in range(len(tok) - k + 1):
                    here = tok[at : at + k]
                    for n, pos, w in by.get((heavy(here), canon(here)), ()):
                        met.add(n)
                        if w == here:
                            equal.add(n)
                        if not heavy(w):
                            slots = [(a, b) for a, b in zip(w, here, strict=True) if a[1] is not None]
                            if w != here:
                                moved.append((n, at - pos, {a for a, _ in slots}))
                                for a, b in slots:
                                    values.setdefault((at - pos, a), set()).add(b)
            ok = equal | {n for n, shift, slots in moved if all(a[0] == "" or len(values[shift, a]) < 2 for a in slots)}
            if len(ok) >= coverage * len(windows):
                found[doc, item] = (len(windows), len(ok), met <= equal)
    return found


def check(spark, docs, items, coverage=0.5):
    prepare(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("raw", F.lit(1)).withColumn("h", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit("y"))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.exact) for r in decontaminate.find(d, b, coverage=coverage).collect()}
    assert got == brute(docs, items, coverage)
    return got


def test_number_heavy_items_are_found_by_their_values(spark):
    item = "Tom 12 Ann 15 Bob 19 Sam 22 and 31 Kim 44 or 51 Lee 62"
    table = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18"
    docs = [(1, item), (2, "x y " + item + " z"), (3, item.replace("15", "16").replace("44", "45")), (4, table), (5, " ".join(map(str, range(40, 90)))), (6, "Well then Ann 15 bob")]
    got = check(spark, docs, [(1, item), (2, table)])
    assert {(1, 1), (2, 1), (4, 2)} <= set(got) and (5, 2) not in got and got[(1, 1)][2]


def test_first_word_of_an_item_may_look_like_a_name(spark):
    short = "Seven words are all that it has"
    got = check(spark, [(1, "so here Seven words are all that it has."), (2, short), (3, "seven words are all that it had")], [(1, short)])
    assert set(got) == {(1, 1), (2, 1)}


def test_random_questions_match_brute_force(spark):
    r = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    piece = lambda: r.choice([lambda: r.choice(words), lambda: r.choice(words), lambda: r.choice(words), lambda: str(r.randrange(1, 9)), lambda: f"{r.randrange(1, 9)} km", lambda: r.choice(("Ann", "Bob", "Kim"))])()
    items = [(i, " ".join(piece() for _ in range(r.choice((3, 7, 9, 14, 25))))) for i in range(12)]
    docs = []
    for i in range(60):
        _, t = r.choice(items)
        w = t.split()
        for j in range(len(w)):
            if w[j].isdigit() and r.random() < 0.3:
                w[j] = str(r.randrange(1, 9))
            elif w[j] in ("Ann", "Bob", "Kim") and r.random() < 0.3:
                w[j] = r.choice(("Ann", "Bob", "Lee"))
            elif r.random() < 0.02:
                w[j] = r.choice(words)
        docs.append((i, " ".join([r.choice(words) for _ in range(r.randrange(6))] + w * r.choice((1, 1, 2)) + [r.choice(words) for _ in range(r.randrange(6))])))
    docs += [(None, docs[0][1]), (3, docs[4][1]), (70, None), (71, "")]
    items += [(None, "a b c"), (20, None), (21, ""), (5, items[2][1])]
    assert len(check(spark, docs, items)) > 20
    check(spark, docs, items, 0.9)


def test_query_matches_brute_force(spark, sf):
    con = connect(sf)
    docs, items = con.execute("select doc_id, text from documents where length(text) < 1500").fetchall(), con.execute("select item_id, text from benchmark").fetchall()
    ids = {d for d, _ in docs}
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.exact) for r in queries.QUERIES["op7_decontamination"](spark, sf).collect()}
    assert {k: v for k, v in got.items() if k[0] in ids} == brute(docs, items)
