"""Durable intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, one is made if all runs in this one process (tests), else it is an error: executors would not see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, lineage cut, survives lost executors.

    The tables of an application lie in one folder, which is removed when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    _folders.add(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    for folder in _folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
