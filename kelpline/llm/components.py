"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import Workspace

#: The steps end in a few more rounds than the logarithm of the longest path; so many mean that something is wrong.
MAX_ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b). Links each neighbour to the least node of the neighbourhood; groups are only aggregated."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return kept.union(least.select("a", F.col("m").alias("b")).filter("a <> b")).distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(a, b) pairs of ids -> (node, component): component is the least id reachable. Nodes without edges are absent.

    Both star steps keep the components and end in stars around the least node. The edge table is written
    between rounds, so lineage stays short; no group is ever collected.
    """
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    now = work.save(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    before, last = tuple(now.agg(F.count("*"), mark).first()), f"{name}-0"
    for i in range(1, MAX_ROUNDS if before[0] else 1):
        now = work.save(_star(_star(now, True), False), f"{name}-{i}")
        work.drop(last)
        last = f"{name}-{i}"
        seen = tuple(now.agg(F.count("*"), mark).first())
        if seen == before:
            break
        before = seen
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
