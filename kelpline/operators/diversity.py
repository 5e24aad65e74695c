"""Spread of a query's results over files: filling up seeds, primary files, candidates to explore."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import path_tokens
from kelpline.operators.fusion import top_k

#: Where an expanded chunk came from, best first, and the priority that it gives.
SOURCES = [("import", 3, "high"), ("breadcrumb", 2, "medium"), ("neighbor", 1, "low")]


def path_overlap(path, words):
    """How many of the words, of three characters or more, hold a token of the path, or are part of one."""
    parts = path_tokens(path)
    return F.size(F.filter(words, lambda w: (F.length(w) >= 3) & F.exists(parts, lambda p: F.contains(p, w) | F.contains(w, p))))


def in_source(path):
    return F.startswith(F.lower(path), F.lit("src/"))


def fill(seeds: DataFrame, candidates: DataFrame, files: int | None = 4, sources: int = 3) -> DataFrame:
    """seeds(query_id, file_path), candidates(query_id, file_path, chunk_index, position) -> the candidates to add.

    Files under src/ come first in order, then, unless files is None, any others, each file once, until a query has
    `files` files and `sources` of them under src/. Where it has them at the start, or has no seed, nothing is added.
    A pass adds exactly as many as are missing, so a rank of each new file decides; no row waits for another.
    """
    src = in_source(F.col("file_path"))
    have = seeds.groupBy("query_id").agg(F.count_distinct("file_path").alias("n_files"), F.count_distinct(F.when(src, F.col("file_path"))).alias("n_src"))
    once = top_k(candidates, ["query_id", "file_path"], ["position"], 1, "again").drop("again").join(seeds.select("query_id", "file_path").distinct(), ["query_id", "file_path"], "left_anti")
    r = once.withColumn("src", src).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "src").orderBy("position")))
    r = r.withColumn("all_src", F.count_if("src").over(Window.partitionBy("query_id"))).join(have, "query_id")
    few = F.lit(0) if files is None else F.lit(files) - F.col("n_files")
    first = F.greatest(few, F.lit(sources) - F.col("n_src"), F.lit(0))
    second = F.when(F.col("n_src") + F.col("all_src") >= sources, few - F.col("all_src")).otherwise(1 << 30)
    take = F.when(F.col("src"), F.col("n") <= first)
    take = take.otherwise(F.lit(False)) if files is None else take.otherwise((first > F.col("all_src")) & (F.col("n") <= second))
    return r.filter(take).select("query_id", "file_path", "chunk_index", "position")


def primary_files(candidates: DataFrame, packed: DataFrame, words: DataFrame, limit: int = 3) -> DataFrame:
    """candidates(query_id, file_path, score), packed(query_id, file_path), words(query_id, words) -> files not packed.

    Files under src/ by how many words their path shares, then by their best score, then by path.
    """
    new = candidates.filter(in_source(F.col("file_path"))).join(packed.select("query_id", "file_path").distinct(), ["query_id", "file_path"], "left_anti")
    best = new.groupBy("query_id", "file_path").agg(F.max("score").alias("score")).join(words, "query_id", "left")
    best = best.withColumn("overlap", path_overlap(F.col("file_path"), F.coalesce("words", F.array().cast("array<string>"))))
    return top_k(best, ["query_id"], [F.col("overlap").desc(), F.col("score").desc(), "file_path"], limit).select("query_id", "file_path", "overlap", "score", "rank")


def explore(expanded: DataFrame, seeds: DataFrame, words: DataFrame, limit: int = 5) -> DataFrame:
    """expanded(query_id, file_path, source, score) -> files to look at next that hold no seed.

    Order: source, words in the path, score, path. A file counts by its best row; priority follows from its source.
    """
    new = expanded.join(seeds.select("query_id", "file_path").distinct(), ["query_id", "file_path"], "left_anti").join(words, "query_id", "left")
    rank, label = F.lit(1), F.lit("low")
    for name, n, priority in SOURCES:
        rank, label = F.when(F.col("source") == name, n).otherwise(rank), F.when(F.col("source") == name, priority).otherwise(label)
    new = new.withColumn("weight", rank).withColumn("overlap", path_overlap(F.col("file_path"), F.coalesce("words", F.array().cast("array<string>"))))
    one = top_k(new, ["query_id", "file_path"], [F.col("weight").desc(), F.col("score").desc()], 1, "again")
    best = top_k(one, ["query_id"], [F.col("weight").desc(), F.col("overlap").desc(), F.col("score").desc(), "file_path"], limit)
    return best.select("query_id", "file_path", "source", label.alias("priority"), "overlap", "score", "rank")
