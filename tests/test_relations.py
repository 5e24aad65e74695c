from __future__ import annotations

import re

from kelpline.operators import graph as G
from kelpline.plans import graph as P
from kelpline.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def test_relations_of_repeated_edges_and_names(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("a", "z", "CALLS"), (None, "b", "CALLS")], "from_id string, to_id string, type string")
    s = spark.createDataFrame([("a", "A", "f"), ("b", "B", "f"), ("b", "B", "g"), ("b", "C", "f")], "id string, name string, file_path string")
    into = {("in", "CALLS", "b", "a", "A"), ("in", "CALLS", "z", "a", "A"), ("in", "CALLS", "b", None, None)}
    out = {("out", "CALLS", "a", "b", "B"), ("out", "CALLS", "a", "b", "C"), ("out", "CALLS", "a", "z", None), ("out", "CALLS", None, "b", "B"), ("out", "CALLS", None, "b", "C")}
    for way, want in (("in", into), ("out", out), ("both", into | out)):
        got = [tuple(r) for r in G.relations(e, s, way).collect()]
        assert len(got) == len(want) and set(got) == want


def test_edges_are_distinct_by_their_keys(spark):
    e = X.edges(spark, SF)
    assert e.count() == e.distinct().count()
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert len(keys) == 4 and not any("concat" in k or "from_id" in k for k in keys)


def test_no_relation_is_compared_behind_its_join(spark):
    for q in (P.j1, P.g2):
        plan = q(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        join = min(i for i, line in enumerate(plan) if "Join" in line)
        assert not any("Aggregate" in line for line in plan[:join])


def test_call_edges_keep_the_given_number_of_partitions(spark):
    from kelpline.sources import fixtures

    plan = fixtures.edges(spark, "/root/testdata/sf0.001").filter("type = 'CALLS'")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and plan.count("Repartition") == 1
