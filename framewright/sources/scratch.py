"""Folders for query round trips: in the shared folder of the session, or in local mode in a folder of this process."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


@functools.lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="spark-dataset-")


def new_folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _local()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table to be broadcast if it has so many rows at most, counted now; larger ones are joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back, so that what reads it several times, or after a lost executor, computes it once.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)
