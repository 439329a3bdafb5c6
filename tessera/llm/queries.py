"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, decontaminate, html_extract, importance, language_id, license_scan, lm_score, mixing, near_dedup, packing, periodic, quality, toxicity
from tessera.llm.common import fold, table


def _held_out(mod: int, rest: int) -> Column:
    """Whether the fold of the key is the one kept from learning. A null key has no fold: it is not held out, and nothing is learned from it."""
    return F.coalesce(fold("doc_id", mod) == rest, F.lit(False)).alias("held_out")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents", "doc_id", "text"), n_words=4, percent=80)


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.resample(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 7) != 2)
    return found.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score", "vocabulary")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold("doc_id", 5) != 0))
    found = language_id.detect(docs, model, spans=False)
    return found.select("doc_id", _held_out(5, 0), "lang_pred", "score", "n_spans")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(table(spark, sf_dir, "documents", "doc_id", "text"), rewrite=periodic.periodic_tail))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_quality_resampling, op3_toxicity, op4_nearest_neighbours, op5_lm_score, op6_source_mixing, op7_decontamination, op8_language_id, op9_main_text, op10_license_scan, op11_importance_resampling, op12_periodic_runs, op13_packing)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": near_dedup.oracle_sql(4, 80), "op10_license_scan": license_scan.oracle_sql(), "op11_importance_resampling": importance.oracle_sql()}
