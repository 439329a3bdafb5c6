"""Importance resampling, periodic runs and packing: brute force, round trips and edge cases on small tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from compare import connect, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import importance, packing, periodic, queries, repeats

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "word " * 30_000), (7, "×÷ ß 你好"), (None, "one two three four five six"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "\x00\x01 !!"), (9, "x y z " * 9 + "x"), (None, None)]


def docs(spark, made, more=False):
    df = spark.createDataFrame(made, "doc_id long, text string")
    return df.withColumns({c: F.lit("7") for c in ("score", "weight", "rank", "bucket", "n", "part", "ids", "runs", "start", "length")}) if more else df


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def buckets(text, n=importance.BUCKETS):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@given(st.text(alphabet="aBz9 -_éß漢\n\x00", max_size=60), st.sampled_from([3, 8, 1 << 20]))
@settings(max_examples=150, deadline=None)
def test_feature_buckets_are_crc32_of_the_grams(text, size):
    kept, importance.SLICE = importance.SLICE, size
    try:
        got = list(importance.features(text.encode(), importance.WordCrc()))
    finally:
        importance.SLICE = kept
    assert sorted(int(b) for _, found in got for b in found) == sorted(buckets(text))
    assert sum(n for n, _ in got) == len(words(text))


def brute_resample(made, target, percent, min_words):
    s, t = np.zeros(importance.BUCKETS, int), np.zeros(importance.BUCKETS, int)
    for _, x in made:
        np.add.at(s, buckets(x), 1)
    for x in target:
        np.add.at(t, buckets(x), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + len(s)) / ((a + 1) * (int(t.sum()) + len(t))))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for k, x in made:
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        out.append([k, len(buckets(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    order = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for n, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_resampling_matches_brute_force_with_ties_and_edges(spark, percent):
    r = random.Random(percent)
    same = " ".join(f"w{r.randrange(9)}" for _ in range(30))
    made = EDGE + [(100 + i, " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 60)))) for i in range(80)] + [(300, same)] * 12 + [(None, same)] * 9
    target = ["w1 w2 w3 w4", None, "", "w5 w6 " * 20]
    got = importance.resample(docs(spark, made, True), spark.createDataFrame([(x,) for x in target], "text string"), percent=percent, min_words=6)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(made, target, percent, 6)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = docs(spark, [(1, "a b c"), (2, None)])
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none, percent=100, min_words=1).collect()
    assert [x["rank"] for x in sorted(got, key=lambda x: x.doc_id)] == [1, None]


def test_resampling_query_matches_its_sql(spark, sf):
    assert rows(queries.op11_importance_resampling(spark, sf).toPandas()) == rows(connect(sf).execute(queries.ORACLE_SQL["op11_importance_resampling"]).df())


def brute_runs(w, min_length=6, min_exponent=4):
    n, out = len(w), {}
    ids = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in w], int)
    for p in range(1, n // 2 + 1):
        step = np.diff(np.concatenate([[0], (a[:-p] == a[p:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if e - s + p >= 2 * p:
                out[(s, e - s + p)] = min(p, out.get((s, e - s + p), p))
    return sorted((s, size, p) for (s, size), p in out.items() if size >= max(min_length, min_exponent * p))


@given(st.lists(st.integers(0, 2), max_size=50), st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(0, 9))
@settings(max_examples=250, deadline=None)
def test_all_runs_of_a_sequence(head, unit, times):
    w = head + unit * times + head[:5]
    got = repeats.runs(np.array([*w, 9], np.int64))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == brute_runs(w, 2, 2)


@pytest.mark.parametrize("limits", [(6, 4), (2, 2), (9, 3)])
def test_runs_of_many_texts_share_trees_and_lose_nothing_to_the_cut(limits):
    r = random.Random(limits[0])
    texts = []
    for _ in range(150):
        t = [b"%d" % r.randrange(r.choice((2, 5, 40))) for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            at, unit = r.randrange(len(t) + 1), [b"%d" % r.randrange(40) for _ in range(r.randrange(1, 9))]
            t[at:at] = unit * r.randrange(2, 7) + unit[: r.randrange(len(unit))]
        texts.append(t)
    kept, periodic.TREE_WORDS = periodic.TREE_WORDS, 300
    try:
        owner, *found = periodic.runs_of(texts, *limits)
    finally:
        periodic.TREE_WORDS = kept
    for n, t in enumerate(texts):
        assert list(zip(*(x[owner == n].tolist() for x in found), strict=True)) == brute_runs(t, *limits), t


def brute_digest(k, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(k).encode()) if k is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None,) * 3
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (k, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % x for x in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_query_matches_brute_force(spark, sf):
    table = connect(sf).execute("select doc_id, text from documents").fetchall()
    assert sorted(map(tuple, queries.op12_periodic_runs(spark, sf).collect())) == sorted(brute_digest(*x) for x in table)


def test_periodic_edges(spark):
    made = [x for x in EDGE if x[0] != 6] + [(6, "word " * 3000)]
    got = periodic.digests(periodic.find(docs(spark, made, True), rewrite=periodic.periodic_tail))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute_digest(*x) for x in made), key=repr)
    found = periodic.find(docs(spark, [(9, "q x y x y x y x y x")])).first()
    assert [tuple(x) for x in found.runs] == [(1, 9, 2)] and found.collapsed == "q x y"
    assert periodic.find(docs(spark, []), rewrite=periodic.periodic_tail).count() == 0


@given(st.dictionaries(st.integers(1, 31), st.integers(0, 300), max_size=20))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_token_once_without_padding(counts):
    made, windows = packing.plan(dict(counts), 32), {}
    for k, n in counts.items():
        number, base = np.arange(n), np.zeros(n, np.int64)
        while len(number):
            seq, offset, size = made.place(np.full(len(number), k), number, base)
            for x in zip(seq.tolist(), offset.tolist(), size.tolist(), strict=True):
                windows.setdefault(x[0], []).append(x[1:])
            base = base + size
            number, base = number[base < k], base[base < k]
    assert sorted(windows) == list(range(made.n_sequences))
    for pieces in windows.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at == 32 or at & (at - 1) == 0
    assert sum(x[1] for p in windows.values() for x in p) == sum(k * n for k, n in counts.items())


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_a_window_is_filled_as_well_as_any_multiset_with_the_greatest_length(counts):
    use = packing.fill(counts, 40)
    assert use[max(counts)] >= 1 and all(n <= counts[k] for k, n in use.items())
    sums = {max(counts)}
    for k, n in counts.items():
        for _ in range(n - (k == max(counts))):
            sums |= {s + k for s in sums if s + k <= 40}
    assert sum(k * n for k, n in use.items()) == max(sums)


@pytest.mark.parametrize("kind", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_are_encoded_like_whole_texts(kind):
    path = public_tokenizers.path(kind)
    r, tokenizer = random.Random(3), Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        enc = packing.Encoder(f.read())
    assert enc.by_words == (kind == "word_bpe_49k.json")
    plain = "".join(map(chr, [*range(33, 127), *range(0xA0, 0x250)]))
    pools = [[*"aB zÉé'sT9٣!?\x1c\x0b\n\t\x00漢字🙂ﬁİßΣς  ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " the ", "'re", "  ", "J\u030c", "e\u0301"], [*plain, "'LL", "n't", " ", " "], [chr(c) for c in range(0x530)]]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(40))) for pool in pools for _ in range(1000)]
    for text, ids in zip(texts, enc.encode([t.encode() for t in texts], 1), strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)


def check_packing(got, made, window):
    """Every document's ids lie in one piece each, sequences have no gap, and none needs padding."""
    tokenizer, left = Tokenizer.from_file(PATH), {}
    for k, t in made:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        left.setdefault((k, len(ids)), []).append(ids)
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sum(map(len, v)) for k, v in left.items()} == {k: sum(r.length for r in v) for k, v in pieces.items()}
    for k, v in left.items():
        if len(v) == 1:
            at = 0
            for r in sorted(pieces[k], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(v[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    for v in windows.values():
        at = 0
        for offset, size in sorted(v):
            assert offset == at
            at += size
        assert at == window or at < window and at & (at - 1) == 0
    assert sorted(windows) == list(range(len(windows)))


def test_packing_query_round_trip(spark, sf):
    check_packing(queries.op13_packing(spark, sf).collect(), connect(sf).execute("select doc_id, text from documents").fetchall(), 2048)


@pytest.mark.parametrize("rows_broadcast", [packing.BROADCAST_ROWS, 0])
def test_packing_edges(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", rows_broadcast)
    r = random.Random(2)
    made = EDGE + [(100 + i, "tok " * r.randrange(90)) for i in range(70)]
    got = packing.pack(docs(spark, made, True).repartition(5), PATH, window=64, with_ids=True)
    check_packing(got.collect(), made, 64)
    packed = {x.sequence_id: x.ids for x in packing.sequences(got).collect()}
    for x in got.collect():
        assert packed[x.sequence_id][x.offset : x.offset + x.length] == x.ids
    assert packing.pack(docs(spark, []), PATH).count() == 0
