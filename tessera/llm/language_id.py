"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

A word's score under a language is the log-likelihood of its character trigrams, learned from labelled documents.
Languages that do not use the word's script are not candidates. Viterbi with a switching penalty then labels runs of
words, so a text in two languages gets a span for each.

Texts are scored in slices of a size that the number of languages sets; a text longer than a slice is cut between words
and labelled as one: the scores at the slices' starts are kept, and each slice is worked out again on the way back. So
memory follows neither the length of a text nor the number of languages. A word longer than half a slice is read in
parts.

Bounded: the model, by 65,536 buckets times the languages.
Defined results: null text or text without a letter is ``und`` with score 0 and no span; with no training rows every
text is ``und``; ties go to the smaller language code; rows of a null or repeated key are labelled each by their text;
training rows without text or language teach nothing; an empty table gives no row; columns other than the key and text
are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Batches, as_text

#: Buckets of hashed character trigrams.
SIZE = 1 << 16
#: Nats a word can speak against a language, and nats a change of language costs.
WORD_CLIP, SWITCH = 6.0, 10.0
#: A language is a candidate for a script that makes up this share of its training letters.
SCRIPT_SHARE = 0.001
#: Scores worked on at once, and the longest slice of a text.
CELLS, LONGEST = 1 << 23, 1 << 20
UNKNOWN = "und"

# First code point of the Unicode ranges of the main scripts, in order.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB07, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case where a letter and 0 elsewhere; its script; whether it is a mark inside words."""
    n = 0x110000
    lower, mark = np.zeros(n, np.uint32), np.zeros(n, bool)
    for c in range(0x41, 0x323B0):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            x = chr(c).lower()
            lower[c] = ord(x) if len(x) == 1 else c
        elif kind == "M":
            mark[c] = True
    starts = np.array([s for s, _ in SCRIPT_RANGES])
    names = np.array([SCRIPTS.index(x) for _, x in SCRIPT_RANGES], np.uint8)
    script = names[np.maximum(np.searchsorted(starts, np.arange(n), side="right") - 1, 0)]
    return lower, script, mark


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: for each letter its trigram's bucket, its script, the index of its word; of each word, its text."""
    lower, script, mark = tables()
    sizes = np.array([len(t) + 2 for t in texts])
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    if mark[raw].any():
        keep = ~mark[raw]
        raw, owner = raw[keep], owner[keep]
    low = lower[raw].astype(np.uint64)
    at = np.flatnonzero(low)
    bucket = ((low[at - 1] * np.uint64(0x9E3779B1) + low[at]) * np.uint64(0x85EBCA77) + low[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    starts = low[at - 1] == 0
    return (bucket >> np.uint64(48)).astype(np.int64), script[raw[at]], np.cumsum(starts) - 1, owner[at[starts]]


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    score: np.ndarray  # float32, bucket x language
    allowed: np.ndarray  # bool, script x language


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Trigram and script counts of every labelled row, summed in Spark; the model is bounded by buckets x languages."""

    def told(seen: dict[str, tuple[np.ndarray, np.ndarray]]) -> Batches:
        for name, (grams, scripts) in seen.items():
            both = np.concatenate([grams, scripts])
            i = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(i), pa.string()), "i": pa.array(i, pa.int64()), "n": pa.array(both[i], pa.int64())})
        seen.clear()

    def count(batches: Batches) -> Batches:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            of: dict[str, list[str]] = {}
            for t, name in zip(as_text(b.column(0)), b.column(1).to_pylist(), strict=True):
                of.setdefault(name, []).extend(pieces(t, LONGEST))
            for name, texts in of.items():
                grams, scripts = seen.setdefault(name, (np.zeros(SIZE, np.int64), np.zeros(len(SCRIPTS), np.int64)))
                ends = np.cumsum([len(t) for t in texts]) // LONGEST
                for i in range(int(ends[-1]) + 1 if len(ends) else 0):
                    bucket, script, _, _ = letters([t for t, x in zip(texts, ends.tolist(), strict=True) if x == i])
                    grams += np.bincount(bucket, minlength=SIZE)
                    scripts += np.bincount(script, minlength=len(SCRIPTS))
                if len(seen) > 64:
                    yield from told(seen)
        yield from told(seen)

    counts = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").mapInArrow(count, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    both = np.zeros((SIZE + len(SCRIPTS), len(langs)))
    both[counts["i"].to_numpy(int), np.searchsorted(langs, counts["lang"].to_numpy(str)) if langs else []] = counts["n"]
    grams, scripts = both[:SIZE] + 0.1, both[SIZE:]
    return LanguageModel(langs, np.log(grams / grams.sum(0)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def word_scores(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of all texts together: score by language (0 for the best, down to -``WORD_CLIP``), letters, text."""
    bucket, script, word, owner = letters(texts)
    n, k = len(owner), len(model.langs)
    step, starts = max(1, CELLS // max(k, 1)), np.flatnonzero(np.diff(word, prepend=-1))
    if 0 < len(word) <= step:
        scores = np.add.reduceat(model.score[bucket], starts, axis=0)
    else:
        scores = np.zeros((n, k), np.float32)
        for at in range(0, len(word), step):
            part = word[at : at + step]
            new = np.flatnonzero(np.diff(part, prepend=-1))
            scores[part[new]] += np.add.reduceat(model.score[bucket[at : at + step]], new, axis=0)
    for at in range(0, n, step):
        rows = slice(at, at + step)
        allowed = model.allowed[script[starts[rows]]]
        part = np.where(allowed, scores[rows], -np.inf)
        top = part.max(1, keepdims=True, initial=-np.inf)
        known = np.isfinite(top)
        scores[rows] = np.maximum(part - top, -WORD_CLIP) if known.all() else np.where(known, np.maximum(part - np.where(known, top, 0), -WORD_CLIP), 0)
    return scores, np.diff(starts, append=len(word)), owner


def _advance(s: np.ndarray, active: np.ndarray, v: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward pass over s (label x word, the words of one step together), which moves v (label x text): whether a label is kept, and the best one before."""
    stay, best, at = np.empty(s.shape, bool), np.empty(s.shape[1], np.uint16), 0
    for k in active:
        old = v[:, :k]
        top = old.max(0) - switch
        best[at : at + k] = old.argmax(0)
        stay[:, at : at + k] = old >= top
        v[:, :k] = np.maximum(old, top) + s[:, at : at + k]
        at += k
    return stay, best


def _retrace(stay: np.ndarray, best: np.ndarray, active: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Labels of the words, from the last ones (end), which move to those before the first."""
    out, at = np.empty(len(best), np.uint16), len(best)
    for k in active[::-1]:
        at -= k
        now = end[:k]
        out[at : at + k] = now
        end[:k] = np.where(stay[now, np.arange(at, at + k)], now, best[at : at + k])
    return out


def viterbi(scores: np.ndarray, owner: np.ndarray, n: int, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word. scores: word x label; owner: the word's text, ascending. All texts advance together."""
    length = np.bincount(owner, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(n)
    first = np.cumsum(length) - length
    step = np.arange(len(owner)) - first[owner]
    order = np.lexsort((rank[owner], step))  # all first words, then all second words, ...; longest text first
    active = np.bincount(step) if len(step) else np.zeros(0, int)
    v = np.zeros((scores.shape[1], n), np.float32)
    stay, best = _advance(np.ascontiguousarray(scores[order].T), active, v, switch)
    labelled = np.empty(len(owner), np.uint16)
    labelled[order] = _retrace(stay, best, active, v.argmax(0))
    return labelled


def slice_size(n_langs: int) -> int:
    return min(max(2 * CELLS // max(n_langs, 1), 4096), LONGEST)


def pieces(text: str, size: int) -> list[str]:
    """The text in pieces of at most so many code points, cut where no word is; in the middle of a word longer than half a piece."""
    lower, _, mark = tables()
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            tail = np.frombuffer(text[at + size // 2 : end].encode("utf-32-le", "surrogatepass"), np.uint32)
            gaps = np.flatnonzero((lower[tail] == 0) & ~mark[tail])
            end = at + size // 2 + int(gaps[-1]) + 1 if len(gaps) else end
        out.append(text[at:end])
        at = end
    return out


def label_long(text: str, model: LanguageModel, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and letters of each word of one text, piece by piece."""
    parts, v = pieces(text, size), np.zeros((len(model.langs), 1), np.float32)
    starts = []
    for p in parts:
        starts.append(v.copy())
        scores, _, owner = word_scores([p], model)
        _advance(np.ascontiguousarray(scores.T), np.ones(len(owner), int), v, SWITCH)
    end, labels, sizes = v.argmax(0), [], []
    for p, start in zip(parts[::-1], starts[::-1], strict=True):
        scores, size_, owner = word_scores([p], model)
        active = np.ones(len(owner), int)
        stay, best = _advance(np.ascontiguousarray(scores.T), active, start, SWITCH)
        labels.append(_retrace(stay, best, active, end))
        sizes.append(size_)
    return np.concatenate(labels[::-1]), np.concatenate(sizes[::-1])


def labelled(texts: list[str], model: LanguageModel, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, label, letters, text counted from the first) of the words of some texts in a row, in order."""
    size = size or slice_size(len(model.langs))
    group, held, first = [], 0, 0

    def together() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        scores, sizes, owner = word_scores(group, model)
        return first, viterbi(scores, owner, len(group)), sizes, owner

    for i, t in enumerate(texts):
        if group and held + len(t) > size:
            yield together()
            group, held = [], 0
        if len(t) > size:
            labels, sizes = label_long(t, model, size)
            yield i, labels, sizes, np.zeros(len(labels), np.int32)
            continue
        first = first if group else i
        group.append(t)
        held += len(t)
    if group:
        yield together()


def detect(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """key, lang_pred, score (share of the letters in spans of that language), n_spans and, if asked, spans: [first word, words, language]."""
    whole = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        m = whole.value
        for b in batches:
            texts = as_text(b.column(1))
            # texts of a length together: those of a group advance as long as its longest
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            place = np.argsort(order)
            texts = [texts[i] for i in order]
            n, k = len(texts), max(len(m.langs), 1)
            share, n_spans, runs = np.zeros((n, k)), np.zeros(n, np.int64), [[] for _ in texts]
            for at, labels, size, owner in labelled(texts, m) if m.langs else ():
                owner = owner.astype(np.int64)
                several = int(owner[-1]) + 1 if len(owner) else 0
                share[at : at + several] += np.bincount(owner * k + labels, size, several * k).reshape(several, k)
                new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels.astype(int), prepend=-1) != 0))
                n_spans[at : at + several] += np.bincount(owner[new], minlength=several)
                if spans:
                    first = np.searchsorted(owner, np.arange(several))
                    for i, size_ in zip(new.tolist(), np.diff(new, append=len(owner)).tolist(), strict=True):
                        runs[at + owner[i]].append({"first": i - int(first[owner[i]]), "words": size_, "lang": m.langs[labels[i]]})
            share, n_spans, runs = share[place], n_spans[place], [runs[i] for i in place]
            total, best = share.sum(1), share.argmax(1)
            pred = [m.langs[x] if t else UNKNOWN for x, t in zip(best, total, strict=True)]
            score = np.where(total > 0, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
            cols = {key: b.column(0), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "n_spans": pa.array(n_spans, pa.int64())}
            if spans:
                cols["spans"] = pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"`{key}` {kind}, lang_pred string, score double, n_spans long" + ", spans array<struct<first:long,words:long,lang:string>>" * spans
    return docs.select(key, text).mapInArrow(run, schema)
