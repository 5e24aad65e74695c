"""Expansion of seed chunks: neighbours in a file, siblings under a breadcrumb, targets of imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import breadcrumb_parent


def neighbours(seeds: DataFrame, chunks: DataFrame, hops: int = 2, decay: float = 0.8) -> DataFrame:
    """Chunks within hops of a seed of the same file, scored by the nearest seed times decay^distance; seeds excluded.

    A band join: every seed names the positions around it, so the join is on equal (file, position).
    """
    reach = seeds.select("query_id", "file_path", F.col("chunk_index").alias("seed"), "score", F.explode(F.sequence(F.col("chunk_index") - hops, F.col("chunk_index") + hops)).alias("chunk_index"))
    reach = reach.filter("chunk_index <> seed").withColumn("distance", F.abs(F.col("chunk_index") - F.col("seed")))
    near = Window.partitionBy("query_id", "file_path", "chunk_index").orderBy("distance", F.col("score").desc())
    reach = reach.withColumn("n", F.row_number().over(near)).filter("n = 1")
    reach = reach.join(seeds.select("query_id", "file_path", "chunk_index"), ["query_id", "file_path", "chunk_index"], "left_anti")
    found = reach.join(chunks.select("file_path", "chunk_index"), ["file_path", "chunk_index"])
    return found.select("query_id", "file_path", "chunk_index", "distance", F.round(F.col("score") * F.pow(F.lit(decay), "distance"), 9).alias("score"))


def siblings(seeds: DataFrame, chunks: DataFrame, limit: int = 3, decay: float = 0.7) -> DataFrame:
    """Up to limit chunks under the breadcrumb parent of a query's seeds, scored by the best seed there; seeds excluded."""
    s = seeds.withColumn("parent", breadcrumb_parent(F.col("breadcrumb"))).groupBy("query_id", "parent").agg(F.max("score").alias("best"))
    c = chunks.select("file_path", "chunk_index", breadcrumb_parent(F.col("breadcrumb")).alias("parent"))
    found = s.join(c, "parent").join(seeds.select("query_id", "file_path", "chunk_index"), ["query_id", "file_path", "chunk_index"], "left_anti")
    w = Window.partitionBy("query_id", "parent").orderBy("file_path", "chunk_index")
    found = found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    return found.select("query_id", "file_path", "chunk_index", F.round(F.col("best") * decay, 9).alias("score"))


def imports(seeds: DataFrame, links: DataFrame, barrels: DataFrame, per_seed: int = 3, decay: float = 0.6, depth_decay: float = 0.7) -> DataFrame:
    """Files that a seed file's links lead to, and through barrel files those that theirs lead to.

    links: (file_path, target); barrels: (file_path). Depth 0 scores seed * decay, depth 1 once more * depth_decay.
    """
    first = seeds.groupBy("query_id", "file_path").agg(F.max("score").alias("score")).join(links, "file_path")
    first = first.select("query_id", F.col("file_path").alias("seed"), "target", (F.col("score") * decay).alias("score"), F.lit(0).alias("depth"))
    through = first.join(barrels.select(F.col("file_path").alias("target")), "target", "left_semi").select("query_id", "seed", F.col("target").alias("file_path"), "score")
    second = through.join(links, "file_path").select("query_id", "seed", "target", (F.col("score") * depth_decay).alias("score"), F.lit(1).alias("depth"))
    both = first.union(second).filter("seed <> target")
    w = Window.partitionBy("query_id", "seed").orderBy("depth", "target")
    both = both.groupBy("query_id", "seed", "target").agg(F.max(F.round("score", 9)).alias("score"), F.min("depth").alias("depth")).withColumn("n", F.row_number().over(w))
    return both.filter(F.col("n") <= per_seed).drop("n")
