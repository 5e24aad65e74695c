"""The folder that driver and executors share, for tables and stream checkpoints of the library's own."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where a local session sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='kelpline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/kelpline/{name}-{uuid.uuid4().hex}"


#: Frees a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run within go as soon as these end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written under the shared folder and read again: a short plan that outlives executors. Its shuffle files go at once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
