"""Text operators: budgets over lines, vocabularies, document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def _leading(lines: Column, cost, budget: Column) -> Column:
    """struct(n, spent): how many leading lines stay within the budget, and what they cost. One pass inside the row, no shuffle."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("spent"), F.lit(False).alias("over"))

    def step(acc: Column, line: Column) -> Column:
        total = acc["spent"] + cost(line, acc["n"])
        stop = acc["over"] | (total > budget)
        return F.struct(F.when(stop, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.when(stop, acc["spent"]).otherwise(total).alias("spent"), stop.alias("over"))

    return F.aggregate(lines, start, step)


def token_budget(df: DataFrame, text: str, budget: int, reserved: str | None = None) -> DataFrame:
    """df with kept_lines, token_count and kept_text: the leading lines whose tokens, with the reserved ones, fit the budget."""
    spare = F.lit(budget) - (F.col(reserved) if reserved else F.lit(0))
    cut = df.withColumn("_lines", F.split(text, "\n", -1))
    cut = cut.withColumn("_cut", _leading(F.col("_lines"), lambda line, _: S.token_estimate(line), spare.cast("long")))
    kept = F.when(F.col("_cut.n") > 0, F.array_join(F.slice("_lines", 1, F.col("_cut.n")), "\n")).otherwise("")
    return cut.select(*df.columns, F.col("_cut.n").alias("kept_lines"), F.col("_cut.spent").alias("token_count"), kept.alias("kept_text"))


def char_cap(df: DataFrame, text: str, max_tokens: int, ratio: int = 4) -> DataFrame:
    """df with kept_lines, token_count and kept_text: leading lines within max_tokens * ratio characters, line ends counted between them."""
    cut = df.withColumn("_lines", F.split(text, "\n", -1))
    cut = cut.withColumn("_cut", _leading(F.col("_lines"), lambda line, n: F.length(line).cast("long") + F.when(n > 0, 1).otherwise(0), F.lit(max_tokens * ratio).cast("long")))
    kept = F.when(F.col("_cut.n") > 0, F.array_join(F.slice("_lines", 1, F.col("_cut.n")), "\n")).otherwise("")
    return cut.select(*df.columns, F.col("_cut.n").alias("kept_lines"), F.ceil(F.col("_cut.spent") / ratio).cast("long").alias("token_count"), kept.alias("kept_text"))


def vocabulary_idf(df: DataFrame, key: str, text: str, min_count: int = 2) -> DataFrame:
    """token, n, df, first_key, first_pos and idf = ln(N / df) of the tokens seen at least min_count times."""
    tok = df.select(key, F.posexplode(S.ascii_tokens(text)).alias("pos", "token"))
    per = tok.groupBy("token", key).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    v = per.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("df"), F.min(F.struct(key, "pos")).alias("first"))
    total = df.agg(F.count_distinct(key).alias("n_docs"))
    v = v.where(F.col("n") >= min_count).join(F.broadcast(total))
    return v.select("token", "n", "df", F.col(f"first.{key}").alias("first_key"), F.col("first.pos").alias("first_pos"), F.log(F.col("n_docs") / F.col("df")).alias("idf"))
