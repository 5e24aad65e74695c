from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm.runs import CommonPrefixes, periodic_runs, run_digests, runs_of, with_loops


def brute(w: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All maximal stretches of every period, with their smallest one."""
    out = {}
    for p in range(1, len(w) + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, exponent * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def expected(doc_id: int | None, text: str | None) -> tuple:
    w = [x for x in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(top if top else (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(2, 5), st.integers(1, 8))
def test_runs_of_blocks(texts, exponent, least):
    sizes = np.array([len(t) for t in texts])
    firsts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    symbols = 10 + np.arange(int((sizes + 1).sum()) + 1)
    for f, t in zip(firsts, texts, strict=True):
        symbols[f : f + len(t)] = t
    got = list(zip(*(x.tolist() for x in runs_of(symbols, firsts, sizes, least, exponent)), strict=True))
    assert got == [(s + f, n, p) for f, t in zip(firsts.tolist(), texts, strict=True) for s, n, p in brute(t, least, exponent)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=80))
def test_common_prefixes(x):
    s = np.array([*x, 9])
    pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
    got = CommonPrefixes(s).shared(*np.array(pairs).T)
    for (i, j), k in zip(pairs, got, strict=True):
        assert (s[i : i + k] == s[j : j + k]).all() and (i + k == len(s) or j + k == len(s) or s[i + k] != s[j + k])


def test_query_against_brute_force(spark):
    r = random.Random(3)
    rows = [(None, "x " * 9), (7, None), (8, ""), (9, " \t\n"), (10, "a a a a a a"), (10, "a a a a a a"), (11, "é ü é ü  é ü é ü é ü é ü")]
    for i in range(20, 220):
        n = r.choice([1, 3, 20, 150])
        rows.append((i, r.choice([" ", "\n", " \x0b"]).join(r.choice("abcde") * r.choice([1, 1, 2]) for _ in range(n))))
        if i % 9 == 0:
            rows[-1] = (i, "p q " * r.randint(1, 30) + rows[-1][1] + " u v w" * r.randint(1, 12))
    df = spark.createDataFrame([(a, b, 0, "z") for a, b in rows], "doc_id long, text string, start int, runs string").repartition(3)
    from pyspark.sql import functions as F

    got = run_digests(periodic_runs(df.withColumn("text", with_loops(F.col("text"), F.col("doc_id")))))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted((expected(*x) for x in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(20, 220)) > 5


def test_odd_documents(spark, odd_docs, no_docs):
    got = run_digests(periodic_runs(odd_docs)).collect()
    assert len(got) == odd_docs.count() and all(r.n_runs == 0 and r.start is None for r in got)
    assert periodic_runs(no_docs).collect() == []


def test_long_repetitive_text(spark):
    """A million equal words, and a long text of one long period."""
    rows = [(1, "ha " * 1_000_000), (2, " ".join(f"w{i}" for i in range(9000)) + (" " + " ".join(f"v{i}" for i in range(5000))) * 5)]
    got = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 1_000_000, 1)] and got[1].collapsed == "ha"
    assert [tuple(x) for x in got[2].runs] == [(9000, 25000, 5000)] and len(got[2].collapsed.split()) == 14000
