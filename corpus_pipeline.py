"""The training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet in the shared folder and reads back as the next one's docs. All stages but the last return the columns of
``documents``; the last adds what the mix takes.

Defined results, of every stage: columns other than those of ``documents`` are dropped; an empty table gives an empty
table; null text, a null language or source, and very long texts are taken as the stage's operator defines. Each row is
decided by itself: where keys are null or repeated, the stage works with numbers of the rows in the order of their keys
(nulls last, then texts), so of near duplicates with one key one row stays, and a copy of a benchmark item goes whatever
its key. Ties go as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, mixing, near_dedup, quality
from tessera.llm.common import numbered, prepare, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose letters are in spans of its main language to less than this share is rejected as undetermined.
LANGUAGE_SHARE = 0.4
ROW = "_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling; documents outside the sample go, those without text with them only if they are not drawn."""
    docs = _rows(spark, docs)
    drawn = quality.resample(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), key=ROW, label_key="doc_id")
    return _without(docs, drawn.where("not sampled").select(ROW))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Span labelling with a model learned from the documents' own languages; undetermined documents go."""
    docs = _rows(spark, docs)
    model = language_id.fit(docs)
    found = language_id.detect(docs, model, key=ROW, spans=False)
    return _without(docs, found.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LANGUAGE_SHARE)).select(ROW))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity of 0.8; the smallest document of each group stays. Documents without a word stay."""
    docs = _rows(spark, docs)
    return _without(docs, near_dedup.groups(docs, key=ROW, n_words=5, percent=80).where("not kept").select(ROW))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = _rows(spark, docs)
    return _without(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), key=ROW).select(ROW))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its source, the copies and the words that the mix takes of it."""
    prepare(spark)
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: None: sampling, Viterbi, sketches and the cube method have no SQL.
ORACLE_SQL = None


def _rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents and ``ROW``, a number of each row that rises with the key: the key itself where it tells all rows apart."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    rows, keys = docs.agg(F.count("*"), F.count("doc_id")).first()
    if rows == keys and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id"))
    return numbered(docs, F.asc_nulls_last("doc_id"), F.xxhash64("text"), name=ROW)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs less the rejected rows; the few of a small list are sent to the documents, else both sides are shuffled by the row."""
    gone = settle(rejected.distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= 200_000 else gone, ROW, "left_anti").select(*COLUMNS)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
