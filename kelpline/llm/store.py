"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows of an Arrow batch at most: batches hold whole texts, so their memory follows the longest ones.
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; sets one only where a local session names none (tests)."""
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kelpline-')}"
        spark.conf.set(CHECKPOINT_CONF, found)
    return found


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local run find this package wherever the driver found it; on a cluster it is installed or shipped."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (env.get("PYTHONPATH"), root) if p)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that gives free memory back when its task ends; idle Python workers then hold little."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def quoted(column: str) -> str:
    """A column's name as it is written in an expression, whatever characters it has."""
    return f"`{column.replace('`', '``')}`"


def through(df: DataFrame, run: Callable[[Iterator], Iterator]) -> DataFrame:
    """mapInArrow that gives rows of df back as they are; names with a dot, which it can't take, are put aside meanwhile."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


class Workspace:
    """Tables of one run. They are plain Parquet, so a lost executor costs only a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        importable(spark)
        if int(spark.conf.get(BATCH_CONF)) not in range(1, BATCH_ROWS + 1):
            spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
        self.root = f"{shared_dir(spark)}/kelpline/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write a table and read it again. Its shuffle files go as soon as it is written: later steps read the table."""
        before = self.spark.conf.get(CLEANUP_CONF, "false")
        self.spark.conf.set(CLEANUP_CONF, "true")
        try:
            df.write.options(**options).parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP_CONF, before)
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, to hold down the disk in use."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
