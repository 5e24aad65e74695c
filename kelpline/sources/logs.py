"""Log files: directory windows, line parsing, key=value strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "requestId string, projectId string, totalMs double, seedCount int, timingMs map<string,double>"


def parse_lines(lines: DataFrame, line: str, markers: list[str]) -> DataFrame:
    """Lines that hold a marker, their JSON from the first brace on; lines with bad JSON are dropped."""
    has = F.lit(False)
    for m in markers:
        has = has | F.contains(F.col(line), F.lit(m))
    body = F.expr(f"substring({line}, instr({line}, '{{'))")
    r = lines.filter(has & F.contains(F.col(line), F.lit("{"))).withColumn("r", F.from_json(body, RECORD)).filter("r.requestId is not null and r.timingMs is not null")
    return r.select(
        F.col("r.requestId").alias("request_id"), F.col("r.projectId").alias("project_id"), F.coalesce("r.totalMs", F.lit(0.0)).alias("total_ms"), F.coalesce("r.seedCount", F.lit(0)).alias("seed_count"),
        F.coalesce(F.col("r.timingMs")["recall"], F.lit(0.0)).alias("recall"), F.coalesce(F.col("r.timingMs")["rerank"], F.lit(0.0)).alias("rerank"),
    )


def latest_files(lines: DataFrame, path: str, n: int) -> DataFrame:
    """Lines of the n last files named app.YYYY-MM-DD.log, by date."""
    named = lines.withColumn("file", F.regexp_extract(path, r"(app\.\d{4}-\d{2}-\d{2}\.log)$", 1)).filter("file <> ''")
    last = named.select("file").distinct().orderBy(F.col("file").desc()).limit(n)
    return named.join(last, "file", "left_semi")


def read_directory(spark, directory: str, n: int) -> DataFrame:
    """Lines (value, path, file) of the n last log files of a directory."""
    lines = spark.read.text(directory).withColumn("path", F.input_file_name())
    return latest_files(lines, "path", n)


def key_values(text: Column) -> Column:
    """`k=v | k=v` as a map; a value keeps later equals signs."""
    parts = F.filter(F.split(text, r"\s*\|\s*"), lambda p: F.contains(p, F.lit("=")))
    pair = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(pair)
