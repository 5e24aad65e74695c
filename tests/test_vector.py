"""Nearest vectors against all distances one by one, in SQL's own terms."""

from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from kelpline.operators import vector


def distance(q, v):
    terms = [(a - b) ** 2 for a, b in zip(q or [], v or [], strict=False) if a is not None and b is not None]
    total = 0.0
    for t in terms:
        total += t
    return float(Decimal(repr(math.sqrt(total))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if terms else None


def test_ties_gaps_and_odd_lengths(spark):
    """Equal vectors go by id; what one of both lacks doesn't count; vectors without a distance stand last."""
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(6)]) for i in range(150)]
    rows += [(i, rows[i % 4][1]) for i in range(150, 260)]
    rows += [(260, None), (261, []), (262, rows[0][1][:3]), (263, [None, *rows[1][1][1:]]), (264, [None] * 6), (265, [*rows[2][1], 5.0])]
    r.shuffle(rows)
    queries = [(i, v) for i, v in rows if i % 5 == 0 or i > 258]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    for k, block, size in ((7, 20, 50), (60, 1000, 1000), (400, 30, 100)):
        got = {}
        for x in vector.knn(v, q, k, block, size).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.distance))
        for i, vec in queries:
            near = sorted(((distance(vec, w), j) for j, w in rows), key=lambda x: (x[0] is None, x[0] or 0.0, x[1]))[:k]
            assert sorted(got[i]) == [(n, j, d) for n, (d, j) in enumerate(near)]


def test_no_row_for_each_pair(spark):
    """Pairs are met by matrix products in cells, not as rows of a join."""
    v = spark.range(50).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding")
    plan = vector.knn(v, v.withColumnRenamed("vec_id", "query_id"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and "zip_with" not in plan


def test_halves_of_the_sixth_place_go_up():
    d = np.array([0.1234565, 1.0000005, 2.5, 0.0, 123456.7890125, 0.0000005, np.nan, np.inf, 3e9 + 0.1234565])
    want = [float(Decimal(repr(float(x))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for x in d if math.isfinite(x)]
    got = vector._rounded(d)
    assert [float(x) for x in got if math.isfinite(x)] == want and math.isnan(got[6]) and got[7] == np.inf
