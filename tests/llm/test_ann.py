from __future__ import annotations

import numpy as np

from kelpline.llm.ann import ListIndex, nearest

SCHEMA = "vec_id long, embedding array<float>, list int, v int"


def brute(x: np.ndarray, ids: np.ndarray, q: int, k: int) -> list[int]:
    v = x.astype(float)
    score = (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
    score[q] = -9
    return ids[np.lexsort((ids, -score))[:k]].tolist()


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32) + 2 * rng.normal(size=(12, 24)).astype(np.float32)[rng.integers(0, 12, 3000)]
    x[500:900] = x[500]  # a very common vector
    rows = [(i, x[i].tolist(), 0, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in nearest(df, df.filter("vec_id % 50 = 0"), 5, n_lists=24).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q, rows in got.items():
        want = brute(x, np.arange(3000), q, 5)
        assert [r for r, *_ in sorted(rows)] == [1, 2, 3, 4, 5]
        hit += len({v for _, v, _ in rows} & set(want))
    assert len(got) == 60 and hit >= 0.9 * 300
    assert [v for _, v, _ in sorted(got[500])] == [501, 502, 503, 504, 505]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, 1), (50, [0.0, 2.0], 1, 1), (1, [1.0, 1.0], 1, 1), (1, [1.0, 1.0], 1, 1), (2, None, 1, 1), (3, [0.0, 0.0], 1, 1), (4, [nan, 1.0], 1, 1), (5, [inf, 1.0], 1, 1), (6, [None, 1.0], 1, 1), (None, [1.0, 1.0], 1, 1), (7, [], 1, 1), (8, [1.0, 2.0, 3.0], 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(df, df.filter("vec_id % 50 = 0"), 5).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert nearest(df.limit(0), df.limit(0)).collect() == []


def test_graph_search_finds_the_nearest_list():
    rng = np.random.default_rng(2)
    index = ListIndex(rng.normal(size=(4000, 16)), 128, 5)
    x = rng.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, _ = index.search(x, beam=32)
    assert (order[:, 0] == (x @ index.centroids.T).argmax(axis=1)).mean() >= 0.95


def test_repeated_rows_do_not_crowd_out_other_ids(spark):
    """The nearest row k times over, and an id with k versions that are all near, among many candidates."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    near = (x[0] + 0.01 * rng.normal(size=(6, 8))).astype(np.float32)
    rows = [(i, x[i].tolist(), 0, 0) for i in range(300)]
    rows += [(1000, near[0].tolist(), 0, 0)] * 5 + [(1001, v.tolist(), 0, 0) for v in near[1:]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.vec_id for r in sorted(nearest(df, df.filter("vec_id = 0"), 5, n_lists=1).collect(), key=lambda r: r.rank)]
    assert set(got[:2]) == {1000, 1001} and got[2:] == brute(x, np.arange(300), 0, 3)
