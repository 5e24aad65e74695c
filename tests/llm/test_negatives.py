from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kelpline.llm.negatives import Lists, mine_negatives, products, stepped
from kelpline.llm.queries import OP11_SQL


def brute(rows: list[tuple], anchors: list[int], low: int = 30, high: int = 90, positives: int = 5, negatives: int = 10) -> list[tuple]:
    """rows (vec_id, label, integer vector), in Python integers."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for a, label, v in rows:
        if a in anchors:
            scored = sorted((-dot(v, w), i, m) for i, m, w in rows if i != a and len(w) == len(v))
            for s, p, _ in [x for x in scored if x[2] == label][:positives]:
                fits = [(i, -t) for t, i, m in scored if m != label and low * -s <= 100 * -t <= high * -s]
                out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits[:negatives])]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, v array<long>, list int, key long".rsplit(", list", 1)[0]).selectExpr("*", "7 AS list", "1L AS key", "0 AS side").repartition(3)


@pytest.mark.parametrize("lists", [1, 7, 60])
def test_against_brute_force(spark, lists):
    rng = np.random.default_rng(lists)
    centres = rng.normal(size=(9, 12)) * 60
    x = np.floor(centres[rng.integers(0, 9, 700)] + rng.normal(size=(700, 12)) * 25).astype(int)
    x[100:260] = x[100]  # many ties
    rows = [(i, int(rng.integers(0, 4)), x[i].tolist()) for i in range(700)]
    df = made(spark, rows)
    got = sorted(tuple(r) for r in mine_negatives(df, df.filter("vec_id % 20 = 0"), n_lists=lists).collect())
    assert got == brute(rows, list(range(0, 700, 20))) and len(got) > 500


def test_clustered_anchors_stop_early(spark):
    """Far clusters can't reach the kth score, so their lists are never asked; the result stays exact."""
    rng = np.random.default_rng(5)
    centres = np.eye(16) * 400
    x = np.floor(centres[np.arange(800) % 16] + rng.normal(size=(800, 16)) * 8).astype(int)
    rows = [(i, int(rng.integers(0, 3)), x[i].tolist()) for i in range(800)]
    df = made(spark, rows)
    got = mine_negatives(df, df.filter("vec_id % 40 = 0"), n_lists=16, low=10, high=100)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, list(range(0, 800, 40)), 10, 100)
    lists = Lists(centres, np.full(16, 60.0), np.ones(16, int), np.zeros(16, bool), np.zeros(16, int))
    order, bound = lists.order(x[0], 0, -(10**9), 10**9, True)
    assert order[0] == 0 and (bound[1:] < (x[0] @ x[16])).all()  # one list is enough


def test_bounds_hold():
    rng = np.random.default_rng(6)
    c, v, a = rng.normal(size=(5, 8)), rng.normal(size=(5, 40, 8)), rng.normal(size=8)
    lists = Lists(c, np.sqrt(((v - c[:, None]) ** 2).sum(-1)).max(1), np.ones(5, int), np.zeros(5, bool), np.zeros(5, int))
    order, bound = lists.order(a, 0, -(10**6), 10**6, False)
    for k, b in zip(order, bound, strict=True):
        assert (v[k] @ a).max() <= b
    few, _ = lists.order(a, 0, int(np.ceil((v @ a).max())) + 1000, 10**6, False)
    assert not len(few)


def test_products_are_exact():
    q = np.array([[2**62, -3], [2**40, 1], [3, 4]])
    got = products(q, np.array([[1, 1], [2**20, 5], [4, 0]]))
    assert got.tolist() == [[2**62 - 3, 2**63 - 1, 2**63 - 1], [2**40 + 1, 2**60 + 5, 2**42], [7, 3 * 2**20 + 20, 12]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (100, [0.0, 0.0], 1), (200, [-1.0, 0.25], 2), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.4], 1), (3, [0.5, 0.3], 2), (4, [0.6, 0.2], 3), (5, [0.6, 0.2], 3), (7, [1.0, 0.0], 0), (14, [0.7, 0.1], 9),
        (6, None, 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (12, [], 1), (300, [1.0, 2.0, 3.0], 1), (301, [1.0, 2.0, 2.0], 1), (302, [0.5, 1.0, 1.0], 2), (-100, [0.3, 0.3], 4),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, list int")
    seen, clean = set(), []
    for i, v, label in rows:
        if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and i not in seen:
            seen.add(i)
            clean.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    vectors = stepped(df)
    got = sorted(tuple(r) for r in mine_negatives(vectors, vectors.filter("vec_id % 100 = 0")).collect())
    assert got == brute(clean, [0, 100, 200, 300, -100]) and len(got) > 10
    assert mine_negatives(vectors.limit(0), vectors.limit(0)).collect() == []


def test_query_sql_agrees_with_brute_force():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    embeddings = pa.table({"vec_id": np.arange(300), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": rng.integers(0, 10, 300)})  # noqa: F841 - read by DuckDB
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, [int(np.floor(256 * float(c))) for c in x[i]]) for i, l in enumerate(embeddings["label"].to_pylist())]
    assert sorted(duckdb.sql(OP11_SQL).fetchall()) == brute(rows, [0, 100, 200])
