"""A store of file snapshots: a table by version, of which each version holds what is new in it.

A version is a folder of the table (``version=3``), written whole, so that writing it again replaces it and a rerun adds
nothing. It holds the files whose text is not the one that the store had before, and tombstones of those that were
cleared. The state as of a version is the newest row of each path up to it: one pre-aggregated shuffle on the path, however
many versions there are, in which texts take part only by their digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_path string, digest string, content string, gone boolean, taken_at timestamp, version int"


def digest(content: str = "content"):
    return F.sha2(F.encode(F.col(content), "UTF-8"), 256)


class Snapshots:
    """The store at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self, upto: int | None) -> DataFrame:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows if upto is None else rows.where(F.col("version") <= upto)

    def _newest(self, upto: int | None) -> DataFrame:
        """file_path, version, digest, gone of the newest row of each path."""
        newest = F.max(F.struct("version", "digest", "gone")).alias("n")
        return self._rows(upto).groupBy("file_path").agg(newest).select("file_path", "n.*")

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("taken_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def create(self, files: DataFrame, version: int) -> None:
        """Take a snapshot of files (file_path, content; one row a path, others of the store keep theirs) as of a version."""
        before = self._newest(version - 1).where("not gone").select("file_path", F.col("digest").alias("_old"), F.lit(True).alias("_held"))
        new = files.select("file_path", digest().alias("digest"), "content").join(before, "file_path", "left")
        changed = new.where(F.col("_held").isNull() | ~F.col("digest").eqNullSafe(F.col("_old")))
        self._write(changed.select("file_path", "digest", "content", F.lit(False).alias("gone")), version)

    def clear(self, version: int, paths: DataFrame | None = None) -> None:
        """Drop the snapshots of the paths (file_path), or of all, as of a version; earlier versions still have them."""
        held = self._newest(version - 1).where("not gone").select("file_path")
        gone = held if paths is None else held.join(paths.select("file_path").distinct(), "file_path", "left_semi")
        none = F.lit(None).cast("string")
        self._write(gone.select("file_path", none.alias("digest"), none.alias("content"), F.lit(True).alias("gone")), version)

    def get(self, version: int | None = None) -> DataFrame:
        """file_path, content, digest, version, taken_at of the snapshots as of a version (the last by default)."""
        newest = self._newest(version).where("not gone").select("file_path", "version")
        return self._rows(version).join(newest, ["file_path", "version"]).select("file_path", "content", "digest", "version", "taken_at")

    def compare(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """file_path and status (new, changed, unchanged, deleted) of the files against the snapshots as of a version."""
        held = self._newest(version).where("not gone").select("file_path", F.col("digest").alias("_old"), F.lit(True).alias("_held"))
        now = files.select("file_path", digest().alias("_new"), F.lit(True).alias("_here"))
        status = F.when(F.col("_here").isNull(), "deleted").when(F.col("_held").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
        return held.join(now, "file_path", "full").select("file_path", status.alias("status"))

    def changed(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """file_path and whether a file's text is not that of its snapshot; a file without one counts as changed."""
        return self.compare(files, version).where("status <> 'deleted'").select("file_path", (F.col("status") != "unchanged").alias("changed"))

    def pairs(self, files: DataFrame, version: int | None = None) -> DataFrame:
        """file_path, old, new of the files whose text is not that of their snapshot, for a diff; a missing snapshot is an empty old text."""
        differ = self.changed(files, version).where("changed").select("file_path")
        old = self.get(version).select("file_path", F.col("content").alias("old"))
        return files.select("file_path", F.col("content").alias("new")).join(differ, "file_path", "left_semi").join(old, "file_path", "left").select("file_path", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
