"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a few general insults plus words and word beginnings that labelled toxic rows hold far more often than
others. Features are densities of the lexicon, closeness of its words to second-person words, and rates of capitals,
punctuation and obfuscation. The labelled rows are split by a hash of the key in three: one part for the lexicon, one
for the trees, one for the calibration, so none is fitted on what another has learned by heart.

Bounded: labelled rows (``label_bound``), chosen by a hash of the key, and the lexicon learned from them
(``lexicon_bound`` entries, those that tell most first).
Every text is scored whole. Labels and other columns are never inputs of a score.
Defined results: null text counts as empty and gets the score of an empty text; without labels of both kinds every score
is the share of toxic labels (0 without any); repeated labels of a key count once, toxic if any is; rows of a null or
repeated key are scored each by their text; a very long text is read whole; equal terms of the lexicon are taken in order
of the term; an empty table gives no row; columns with clashing names are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Batches, as_text, settle

LABEL_BOUND, LEXICON_BOUND = 20_000, 5_000
PREFIXES = (4, 5, 6)
# General insults; words that address the reader in some languages; letters that digits and signs stand for.
SEED_WORDS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb fool jerk".split()
SECOND_PERSON = frozenset("you your yours yourself ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes ti tus su vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
_WORD = re.compile(r"[^\W_]+(?:[@$*.'’_-][^\W_]+)*")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[\d@$*])")
_LONG = re.compile(r"(\w)\1\1")
NAMES = ["hits", "hit_rate", "strength", "strongest", "stem_hits", "stem_rate", "stem_strength", "stem_strongest", "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "punctuation", "obfuscated", "stretched", "log_words"]


def plain(word: str) -> str:
    """A word without disguise: signs inside it removed, digits read as letters where it has letters as well."""
    if word.isalpha():
        return word
    return re.sub(r"[^\w]|_", "", word.translate(LEET)) if not word.isdigit() else word


class Lexicon(dict):
    """Word -> (weight of the word, weight of its beginning, whether it is disguised); remembered, bounded."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> tuple[float, float, bool]:
        bare = plain(word)
        out = (self.words.get(bare, 0.0), max((self.stems.get(bare[:k], 0.0) for k in PREFIXES if len(bare) >= k), default=0.0), bare != word and bool(_MIXED.match(word)))
        self[word] = out
        return out

    def trim(self) -> None:
        if len(self) > 300_000:
            self.clear()


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    found = [lexicon[w] for w in low]
    hits = [(i, x) for i, (x, _, _) in enumerate(found) if x]
    stems = [(i, x) for i, (_, x, _) in enumerate(found) if x]
    second = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = 0
    if second and (hits or stems):
        at = np.array(second)
        near = sum(bool(np.abs(at - i).min() <= 5) for i, _ in (hits or stems))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    upper = len(re.findall("[A-Z]", text))
    size = max(len(text), 1)
    return [
        len(hits), len(hits) / n, sum(x for _, x in hits) / n, max((x for _, x in hits), default=0.0), len(stems), len(stems) / n, sum(x for _, x in stems) / n, max((x for _, x in stems), default=0.0),
        near / max(len(hits) or len(stems), 1), len(second) / n, upper / max(letters, 1), sum(len(w) > 2 and w.isupper() for w in words) / n, text.count("!") / size, len(re.findall(r"[!?.,;:*#$%&|]", text)) / size,
        sum(x for _, _, x in found) / n, len(_LONG.findall(text)) / n, float(np.log1p(len(words))),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth 3 over binned features; nodes as arrays."""

    edges: list[np.ndarray]
    feature: np.ndarray  # tree x 7
    cut: np.ndarray  # tree x 7: bins above go right
    leaf: np.ndarray  # tree x 8
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(3):
                node = 2 * node + 1 + (b[row, f[node]] > c[node])
            out += v[node - 7]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.2, bins: int = 32, ridge: float = 3.0) -> Trees:
    """Newton boosting of the logistic loss, histogram splits, depth 3."""
    edges = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, bins)[:-1], method="lower")) for c in x.T]
    edges = [np.unique(np.concatenate([[0.0], e])) for e in edges]
    b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width, (n, d) = bins + 2, x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    raw = np.full(n, start)
    flat = b + np.arange(d) * width
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, f, c = np.zeros(n, int), np.zeros(7, int), np.full(7, width, int)
        for depth in range(3):
            for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                at = np.flatnonzero(node == k)
                if len(at) >= 8:
                    cells = flat[at].ravel()
                    gs = np.cumsum(np.bincount(cells, np.repeat(g[at], d), d * width).reshape(d, width), 1)
                    hs = np.cumsum(np.bincount(cells, np.repeat(h[at], d), d * width).reshape(d, width), 1)
                    total_g, total_h = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                    gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
                    j, s = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[j, s] > 1e-3:
                        f[k], c[k] = j, s
                node[at] = 2 * k + 1 + (b[at, f[k]] > c[k])
        v = np.bincount(node - 7, g, 8) / (np.bincount(node - 7, h, 8) + ridge) * rate
        raw += v[node - 7]
        feature.append(f)
        cut.append(c)
        leaf.append(v)
    return Trees(edges, np.array(feature), np.array(cut), np.array(leaf), start)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw, probability) of a rising step curve; one row of each kind is added at the ends."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for r, v in zip(np.concatenate([[raw.min()], raw[order], [raw.max()]]), np.concatenate([[0.0], y[order].astype(float), [1.0]]), strict=True):
        blocks.append([r * 1.0, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            r1, v1, n1 = blocks[-2]
            r2, v2, n2 = blocks.pop()
            blocks[-1] = [(r1 * n1 + r2 * n2) / (n1 + n2), (v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]
    return np.array([x[0] for x in blocks]), np.array([x[1] for x in blocks])


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x) if self.trees else np.zeros(len(x))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def _lexicon(known: DataFrame, n_toxic: int, n_clean: int, bound: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings whose share of toxic rows stands out, by smoothed log odds; at most ``bound`` in all."""

    def count(batches: Batches) -> Batches:
        for b in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for t, toxic in zip(as_text(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = {plain(w.lower()) for w in _WORD.findall(t)}
                for term in [(w, 0) for w in words] + [(w, k) for k in PREFIXES for w in {w[:k] for w in words if len(w) >= k}]:
                    seen.setdefault(term, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in seen], pa.string()), "k": pa.array([k for _, k in seen], pa.int32()), "clean": pa.array([x[0] for x in seen.values()], pa.int64()), "toxic": pa.array([x[1] for x in seen.values()], pa.int64())})

    terms = known.select("text", "toxic").mapInArrow(count, "term string, k int, clean long, toxic long").groupBy("term", "k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.1) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.3) / (n_clean + 1.0))
    # a row's chance to hold the term without being toxic must be small against what toxic rows show
    top = terms.where(F.col("toxic") >= 2).withColumn("odds", odds).where((F.col("odds") > 2.5) & (F.col("toxic") >= 2 * F.col("clean") * n_toxic / (n_clean + 1.0))).orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term", "k").limit(bound).collect()
    words, stems = {w: 4.0 for w in SEED_WORDS}, {}
    for r in top:
        (stems if r["k"] else words)[r["term"]] = float(min(r["odds"], 8.0))
    return words, stems


def _featured(docs: DataFrame, model: tuple[dict, dict], keep: list[str]) -> DataFrame:
    """The columns named and x, the features of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        lexicon = Lexicon(*shared.value)
        for b in batches:
            x = [features(t, lexicon) for t in as_text(b.column(0))]
            lexicon.trim()
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", label_bound: int = LABEL_BOUND, lexicon_bound: int = LEXICON_BOUND) -> Model:
    """A model from at most ``label_bound`` labelled rows, with at most ``lexicon_bound`` learned terms."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit(31), key), key).limit(label_bound)
    part = F.pmod(F.xxhash64(F.lit(37), key), F.lit(10)).cast("int").alias("part")
    known = settle(docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).select(key, "text", "toxic", part))
    counts = {(r["toxic"], r["p"]): r["count"] for r in known.groupBy("toxic", (F.col("part") < 4).cast("int").alias("p")).count().collect()}
    n_toxic, n_clean = sum(n for (t, _), n in counts.items() if t == 1), sum(n for (t, _), n in counts.items() if t == 0)
    if not n_toxic or not n_clean:
        share = 1.0 if n_toxic else 0.0
        return Model({}, {}, None, (np.zeros(1), np.array([share])))
    words, stems = _lexicon(known.where("part < 4"), counts.get((1, 1), 0), counts.get((0, 1), 0), lexicon_bound)
    got = _featured(known.where("part >= 4"), (words, stems), ["toxic", "part"]).orderBy("part", "toxic", F.hash("x")).toPandas()
    y, p = got["toxic"].to_numpy(int), got["part"].to_numpy(int)
    x = np.stack(got["x"].to_numpy())
    a, b = p < 8, p >= 8
    if not (0 < y[a].sum() < a.sum()) or not b.any():
        a = b = np.ones(len(y), bool)
    trees = boost(x[a], y[a])
    return Model(words, stems, trees, isotonic(trees.raw(x[b]), y[b]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        m = shared.value
        lexicon = Lexicon(m.words, m.stems)
        for b in batches:
            texts = as_text(b.column(1))
            x = np.array([features(t, lexicon) for t in texts]).reshape(len(texts), len(NAMES))
            lexicon.trim()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
