"""Rank fusion, cut-offs, packing and interval merging, as windows over scored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K0 = 20


def fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The hits of first, and for each query_id without any there those of second; both have the same columns."""
    return first.unionByName(second.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def rrf(lists: DataFrame, key: list[str], weights: dict[str, float], k0: int = K0) -> DataFrame:
    """(query_id, key..., source, rank) -> (query_id, key..., score, source, sources): sum of weight / (k0 + rank).

    A missing rank counts as 0, the best. source is 'vector' where a vector list has the row, else 'lexical'.
    """
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    part = weight / (k0 + F.coalesce("rank", F.lit(0)))
    out = lists.groupBy("query_id", *key).agg(F.round(F.sum(part), 9).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.withColumn("source", F.when(F.array_contains("sources", "vector"), "vector").otherwise("lexical"))


def top_k(scored: DataFrame, by: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """Best k rows of each group, with their zero-based rank."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).filter(F.col(rank) < k)


def rerank_pool(scored: DataFrame, key: list[str], top_n: int = 10, min_pool: int = 12, max_pool: int = 24, share: float = 0.6) -> DataFrame:
    """The first max(top_n, min_pool) rows, then on while the score is at least share of the best, max_pool at most."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *key)
    r = scored.withColumn("n", F.row_number().over(w)).withColumn("top", F.first("score").over(w))
    base = max(top_n, min_pool)
    miss = F.when((F.col("n") > base) & (F.col("score") < F.col("top") * share), F.col("n"))
    r = r.withColumn("stop", F.min(miss).over(Window.partitionBy("query_id")))
    return r.filter((F.col("n") <= max_pool) & (F.col("stop").isNull() | (F.col("n") < F.col("stop")))).drop("top", "stop")


def smart_cutoff(scored: DataFrame, key: list[str], ratio: float = 0.5, delta: float = 0.25, floor: float = 0.25, min_k: int = 2, max_k: int = 8) -> DataFrame:
    """A prefix of each query's ranking: a best score under the floor leaves one row; the first min_k need the floor only,
    later ones max(floor, min(best * ratio, best - delta)); the first miss stops. Keys repeat once; where fewer than
    min(min_k, max_k) keys remain, the next different ones above the floor fill up.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "position")
    q = Window.partitionBy("query_id")
    r = scored.withColumn("n", F.row_number().over(w) - 1).withColumn("top", F.max("score").over(q))
    limit = F.when(F.col("n") < min_k, F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.least(F.col("top") * ratio, F.col("top") - delta)))
    r = r.withColumn("stop", F.coalesce(F.min(F.when(F.col("score") < limit, F.col("n"))).over(q), F.lit(1 << 30)))
    picked = F.when(F.col("top") < floor, F.col("n") == 0).otherwise((F.col("n") < F.col("stop")) & (F.col("n") < max_k))
    r = r.withColumn("picked", picked)
    r = r.withColumn("again", F.row_number().over(Window.partitionBy("query_id", *key).orderBy("n")))
    one = F.col("again") == 1
    r = r.withColumn("kept", F.sum((F.col("picked") & one).cast("int")).over(q))
    spare = ~F.col("picked") & one & (F.col("score") >= floor) & (F.col("top") >= floor)
    r = r.withColumn("fill", F.sum(spare.cast("int")).over(q.orderBy("n")))
    return r.filter((F.col("picked") & one) | (spare & (F.col("kept") + F.col("fill") <= min(min_k, max_k)))).select(*scored.columns)


def merge_intervals(spans: DataFrame, by: list[str], start: str, end: str, **aggs) -> DataFrame:
    """Overlapping or touching (start <= running end) intervals of a group become one; aggs: name -> aggregate column."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = spans.withColumn("fresh", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    r = r.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged"), *[a.alias(n) for n, a in aggs.items()])


def pack(segments: DataFrame, max_per_file: int = 3, max_chars: int = 48000, max_blocks: int = 12) -> DataFrame:
    """(query_id, file_path, start, score, length) -> the packed prefix, with its position.

    Files by best score; at most max_per_file segments of each by score, then by offset; the first segment that would
    exceed max_chars or max_blocks ends the pack.
    """
    file = Window.partitionBy("query_id", "file_path")
    r = segments.withColumn("n", F.row_number().over(file.orderBy(F.col("score").desc(), "start"))).filter(F.col("n") <= max_per_file)
    r = r.withColumn("best", F.max("score").over(file))
    order = Window.partitionBy("query_id").orderBy(F.col("best").desc(), "file_path", "start")
    r = r.withColumn("position", F.row_number().over(order)).withColumn("used", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.filter((F.col("position") <= max_blocks) & (F.col("used") <= max_chars)).drop("n", "best")
