"""Rows that joins hand on grow with the rows that come in, not with the pairs of rows that share a common key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelpline.operators import memory, snippet


@pytest.fixture
def joined(spark):
    """Runs a DataFrame and gives the rows of its joins; works with adaptive plans off, which hide their nodes."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")

    def rows(df) -> int:
        df.collect()
        nodes, total = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
            if "Join" in node.nodeName():
                total += node.metrics().get("numOutputRows").get().value()
        return total

    yield rows
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_path_lookup_of_a_module_that_many_share(spark, joined):
    m = spark.range(500).select("id", F.lit("One Name").alias("name"), F.lit("src/a").alias("dir"), F.array(F.lit("f.ts")).alias("files"))
    want = F.element_at(F.array(*map(F.lit, ("features/one-name.json", "src/a/f.ts", "f.ts", "a/f.ts"))), (F.col("id") % 4 + 1).cast("int"))
    got = memory.find_by_path(spark.range(400).select(F.col("id").alias("request_id"), want.alias("path")), m)
    assert joined(got) < 4000
    assert {(r.request_id % 4, r.tier, r.id) for r in got.collect()} == {(0, "record", 0), (1, "exact", 0), (2, None, None), (3, None, None)}


def test_tiered_resolution_of_a_name_that_many_share(spark, joined, tmp_path):
    from kelpline.plans import graph

    sf, n = str(tmp_path), 400
    # One name in one file, and no request goes by its id.
    spark.range(n).select((F.col("id") * 600 + 1).alias("p_partkey"), F.lit("bolt").alias("p_name")).write.parquet(f"{sf}/part.parquet")
    for t, k, name in (("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        spark.range(1).select(F.col("id").alias(k), F.lit("x").alias(name)).write.parquet(f"{sf}/{t}.parquet")
    got = graph.j4(spark, sf)
    assert joined(got) < 20 * n
    parts = {r.request_id: (r.tier, r.target) for r in got.collect() if r.request_id.startswith("p")}
    order = sorted(parts)
    assert len({t for t in parts.values()}) == 2 and all(tier == 1 and target in parts for tier, target in parts.values()) and len(order) == n


def test_files_that_hold_short_items(spark):
    from kelpline.plans import retrieval

    files = spark.createDataFrame([("a", "xone two three"), ("b", "p one two three four five six seven"), ("c", "one\ntwo three four five sixth"), ("d", None)], "path string, content string")
    items = spark.createDataFrame([(1, "one two"), (2, "one two three four five six"), (3, "one two three four five"), (4, "zero")], "query_id int, query string")
    assert sorted(map(tuple, retrieval.holders(files, items).collect())) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]


def test_cold_start_of_terms_that_most_files_hold(spark, joined):
    rows = [(f"src/{i:03}.ts", 20, f"xalphax b{i}\nnaïve" if i % 2 else "alpha /7") for i in range(300)] + [(None, 5, "alpha")]
    files = spark.createDataFrame(rows, "path string, size long, content string")
    terms = spark.createDataFrame([(q, n, x, x == "/7") for q in range(30) for n, x in enumerate(("alpha", "naïve" if q % 2 else "/7"))], "query_id int, n int, term string, technical boolean")
    got = snippet.cold_start(files, terms)
    assert joined(got) < 3000
    best = sorted((r.query_id, r["rank"], r.path, r.score, r.token) for r in got.collect())
    assert best == [(q, k, f"src/{2 * k + q % 2:03}.ts", 10 if q % 2 else 25, "alpha") for q in range(30) for k in range(5)]


def test_members_of_an_owner_name_that_many_share(spark, joined):
    from kelpline.operators import members

    n = 300
    cols = "id string, name string, type string, file_path string, language string, exported boolean, parent_id string, start_line int"
    rows = [(f"c{k}", "C", "Class", f"f{k}", "go" if k % 2 else "java", k == 7, None, 1) for k in range(n)]
    rows += [(f"m{k}", "run", "Method", f"f{k}", "go" if k % 2 else "java", False, f"c{k}", 2) for k in range(n)]
    asks = [(r, "C", "run", f"f{r}" if r % 3 == 0 else None, "java" if r % 2 else None) for r in range(n)]
    got = members.find_members(spark.createDataFrame(asks, "request_id int, owner string, member string, file_path string, language string"), spark.createDataFrame(rows, cols))
    assert joined(got) < 4 * n
    found = {r.request_id: (r.owner_id, r.member_id) for r in got.collect()}
    # No class of an odd number is in Java; the exported one goes first, else the first file.
    want = {r: (r if r % 3 == 0 else 0 if r % 2 else 7) for r in range(n) if r % 6 != 3}
    assert found == {r: (f"c{k}", f"m{k}") for r, k in want.items()}


def test_the_last_step_of_an_impact_search_takes_sets_along(spark, joined):
    from kelpline.operators import graph

    seeds = spark.range(200).selectExpr("concat('s', id) AS seed")
    edges = seeds.selectExpr("seed AS from_id", "'m' AS to_id", "'X' AS type").union(spark.range(50).selectExpr("'m'", "concat('n', id)", "'Y'"))
    got = graph.impact(edges, seeds, 2)
    assert joined(got) < 500
    want = {(f"s{i}", "m", 1, "X") for i in range(200)} | {(f"s{i}", f"n{j}", 2, "Y") for i in range(200) for j in range(50)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
