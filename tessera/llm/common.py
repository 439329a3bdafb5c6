"""Shared plumbing of the training-data operators: table access, folds, word tokens, durable tables.

Everything that needs Python runs in Arrow batches of bounded size (``prepare``), and every intermediate that is
read twice is written to the folder all executors share (``settle``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.tables import settle, shared_dir  # noqa: F401

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: Words a worker remembers the hash of.
HASH_CACHE = 300_000


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever else the table holds is never read."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(key: str | Column, mod: int) -> Column:
    """crc32 of the key's decimal text, modulo ``mod``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % mod


def uniform(key: str | Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    key = F.col(key) if isinstance(key, str) else key
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df, written, with a number of each row from 0 on in the given order (``name``).

    Rows are dealt by ranges of the order and of a number of their own, so equal rows spread over several ranges: no
    task gets more than a range. The driver sees one count per range. Rows that the order does not tell apart are numbered
    as they lie in df.
    """
    last = F.monotonically_increasing_id()
    placed = settle(df.withColumn("_last", last).repartitionByRange(*order, F.col("_last")).sortWithinPartitions(*order, F.col("_last")).withColumn("_at", last).drop("_last"))
    part = F.shiftright("_at", 33)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], before))
        before += r["count"]
    first = df.sparkSession.createDataFrame(starts, "_part long, _first long")
    joined = placed.withColumn("_part", part).join(F.broadcast(first), "_part")
    return joined.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_first")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def as_text(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


class WordHash(dict):
    """64-bit hash of a word, remembered; ``trim`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > HASH_CACHE:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: exactly what splitting bytes at ASCII white space gives."""
    return text.lower().split() if text else []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


Batches = Iterator[pa.RecordBatch]


