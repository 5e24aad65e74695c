from __future__ import annotations

import random

import numpy as np

from kelpline.llm.components import connected_components
from kelpline.llm.minhash import SIGNED_HASHES, bounds, near_duplicates, signatures, survive
from kelpline.llm.store import Workspace
from kelpline.llm.words import shingle_sets

from .conftest import words


def shingles(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in sets}


def test_matches_brute_force(spark):
    r = random.Random(5)
    rows = []
    for g in range(12):
        base = words(120, 100 + g).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, words(80, 500 + i)) for i in range(40)] + [(2000, "A b c"), (2001, "a B  c"), (2002, "a b d")]
    found = {x.doc_id: x for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {i: x.component_id for i, x in found.items()} == want
    assert all(x.kept == (i == x.component_id) for i, x in found.items())
    assert all(x.n_shingles == len(shingles(dict(rows)[i])) for i, x in found.items())


def test_chain_links_through_the_middle(spark):
    """a and c are too far apart; b joins them, whatever the order of ids."""
    base = words(100, 9).split()
    a, b, c = (" ".join(["x"] * 0 + base[k : k + 90]) for k in (0, 5, 10))
    for ids in ((1, 2, 3), (2, 3, 1), (3, 1, 2), (1, 3, 2)):
        rows = list(zip(ids, (a, b, c), strict=True))
        got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows)


def test_odd_rows(odd_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(x.doc_id, x.n_shingles): x for x in got}
    assert by[(1, 0)].component_id == 1 and by[(1, 0)].kept
    assert {x.component_id for x in got if x.doc_id in (6, 7, 8, 9)} == {6}
    assert {x.component_id for x in got if x.doc_id in (4, -5)} == {-5}
    assert all(x.component_id is None and x.kept for x in got if x.doc_id is None)
    assert len({x.component_id for x in got if x.doc_id == 10}) == 1


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_signature_estimates_similarity():
    a = shingle_sets([words(400, 1).encode()])[0]
    b = np.concatenate([a[: len(a) // 2], shingle_sets([words(200, 2).encode()])[0]])
    sig, keys = signatures([a, np.unique(b)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1 and keys.shape == (2, 32)


def test_pruning_keeps_pairs_at_the_threshold():
    r = np.random.default_rng(0)
    a = r.integers(0, 256, (4000, SIGNED_HASHES), dtype=np.uint8)
    b = np.where(r.random(a.shape) < 0.75, a, r.integers(0, 256, a.shape, dtype=np.uint8))
    low = np.where(r.random(a.shape) < 0.4, a, r.integers(0, 256, a.shape, dtype=np.uint8))
    limits = bounds(0.75)
    assert len(survive(a, b, limits)) >= 0.995 * len(a) and len(survive(a, low, limits)) <= 0.01 * len(a)


def test_components_of_paths_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(300, 301), (301, 302), (302, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect())
    assert all(got[i] == i // 50 * 50 for i in got if i < 200) and got[301] == got[302] == 300


def test_pruning_loses_hardly_any_pair_at_the_threshold():
    """The exact chance that a pair of similarity 0.75 falls under a bound at one of the looks."""
    shown, alive, at = 0.75 + 0.25 / 256, np.ones(1), 0
    for n, least in bounds(0.75):
        for _ in range(n - at):
            alive = np.append(alive * (1 - shown), 0) + np.append(0, alive * shown)
        alive[:least] = 0
        at = n
    assert 1 - alive.sum() < 2e-5
