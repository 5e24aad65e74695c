"""Directory crawls and JSON imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def crawl(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Files under root with path, mtime, size and, if asked for, content. Files that go meanwhile are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreMissingFiles", True).load(root)
    out = files.select(F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    return out


def import_json(lines: DataFrame, column: str, schema: str, required: list[str]) -> DataFrame:
    """JSON documents as rows; those that are malformed or lack a required field are dropped."""
    r = lines.select(F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null").select("r.*")
    for name in required:
        r = r.filter(F.col(name).isNotNull())
    return r
