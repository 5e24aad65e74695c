"""Symbols, relations and chunks of source files in four languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.operators import chunking, syntax
from kelpline.plans.registry import Family
from kelpline.sources import code

family = Family()


@family.add("g11_symbols_of_sources", f"WITH {code.SOURCES} SELECT path, type, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, parent, exported FROM s")
def g11_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syntax.symbols(code.sources(spark, sf_dir))
    parent = F.when(F.col("parent_id").isNotNull(), F.split("parent_id", ":")[3])
    return found.select(F.col("file_path").alias("path"), "type", "name", "start_line", "end_line", parent.alias("parent"), "exported")


@family.add("g11_relations_of_sources", f"WITH {code.SOURCES} {code.RELATIONS}")
def g11_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, heritage, calls, accesses and members, fed from the symbols of the same files."""
    _, edges = syntax.extract(code.sources(spark, sf_dir))
    parts = F.split("from_id", ":")
    outside = F.col("to_id").startswith("external:")
    to = F.when(outside, F.regexp_replace("to_id", "^external:[^:]*:[^:]*:", "")).otherwise(F.split("to_id", ":")[3])
    return edges.select(parts[1].alias("path"), parts[3].alias("from_name"), "type", to.alias("to_name"), "confidence", "reason")


@family.add("c2_structure_chunks", f"WITH {code.SOURCES}, {code.CONTENT} SELECT path, md5(content) AS content, CAST(length(content) AS BIGINT) AS chars, CAST(length(regexp_replace(content, '\\s', '', 'g')) AS BIGINT) AS solid, 0 AS gaps, 0 AS over, true AS several FROM rendered")
def c2_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every file, put together again: the text they cover, gaps and overlaps of raw spans, chunks over the budget."""
    files = code.sources(spark, sf_dir)
    chunks = chunking.structure_chunks(files, 120, 20, 10)
    before = F.lag("raw_end").over(Window.partitionBy("path").orderBy("chunk_index"))
    c = chunks.withColumn("gap", F.col("raw_start") != F.coalesce(before, F.lit(0))).join(files.select("path", "content"), "path")
    c = c.withColumn("part", F.expr("substr(content, raw_start + 1, raw_end - raw_start)"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "part"))), lambda x: x["part"])
    solid = F.sum(F.length(F.regexp_replace("part", r"\s", "")))
    return c.groupBy("path").agg(
        F.md5(F.array_join(parts, "")).alias("content"), F.sum(F.length("part")).cast("long").alias("chars"), solid.alias("solid"), F.sum(F.col("gap").cast("int")).cast("int").alias("gaps"),
        F.sum((F.col("solid") > 1.5 * 120).cast("int")).cast("int").alias("over"), (F.count("*") > 1).alias("several"),
    )


@family.add("c2_overlap_and_context", f"WITH {code.SOURCES}, {code.CONTENT} SELECT path, true AS within_budget, true AS solid_overlap, true AS inside FROM rendered")
def c2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file: whether every overlap is within a quarter of the raw budget and of just so many solid characters, and whether the class is a context."""
    files = code.sources(spark, sf_dir)
    c = chunking.structure_chunks(files, 60, 10, 12).join(files.select("path", "content"), "path")
    solid = F.length(F.regexp_replace(F.expr("substr(content, vector_start + 1, start - vector_start)"), r"\s", ""))
    fine = (F.col("vector_start") == F.col("start")) | (solid == 12)
    inside = F.coalesce(F.get(F.split("context", " > "), F.lit(1)).isin("class Doc", "type Doc"), F.lit(False))
    return c.groupBy("path").agg(F.min(F.col("start") - F.col("vector_start") <= 60).alias("within_budget"), F.min(fine).alias("solid_overlap"), F.max(inside).alias("inside"))
