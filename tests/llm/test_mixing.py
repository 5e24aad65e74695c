from __future__ import annotations

import random

import pytest

from kelpline.llm.mixing import mix_sources, mixed_documents, source_targets


def fill(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Targets by repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, stopped = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        if not open_:
            return stopped
        level = (left - sum(stopped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > cap * sizes[s]]
        if not over:
            return stopped | {s: level * weight[s] for s in open_}
        stopped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 30, None: 400}, {"z": 7}, {"a": 0, "b": 5, "c": 900, "d": 1, "e": 50}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {x.source: x.target for x in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_taken_words(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000))
    assert got == mix_sources(docs).collect() or sorted(got) == sorted(mix_sources(docs.repartition(7)).collect())
    assert all(x.taken == x.copies * x.size and 0 <= x.copies <= 2 for x in got)
    for s in {x.source for x in got}:
        own = [x for x in got if x.source == s]
        assert sum(x.size for x in own) == own[0].source_size
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)


def test_expectation_is_kept(spark):
    """Over many seeds every document is taken about as often as its source's rate."""
    rows = [(i, " ".join(["w"] * (1 + i)), "a" if i < 8 else "b") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, runs = dict.fromkeys(range(12), 0), 60
    for seed in range(runs):
        for x in mix_sources(docs, seed=seed).collect():
            total[x.doc_id] += x.copies
            rate = {"a": x.target / x.source_size} if x.source == "a" else {"b": x.target / x.source_size}
    got = [total[i] / runs for i in range(8, 12)]
    assert all(abs(g - rate.get("b", g)) < 0.3 for g in got)


def test_odd_rows(odd_docs, no_docs):
    got = mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(x.taken == 0 for x in got if x.size == 0)
    assert len({x.copies for x in got if x.doc_id == 6}) == 1
    assert mix_sources(no_docs).collect() == []


def test_mix_has_the_columns_and_copies(odd_docs):
    mix = mixed_documents(odd_docs)
    assert mix.columns == odd_docs.columns
    assert mix.count() == sum(x.copies for x in mix_sources(odd_docs).collect())


def test_plan_is_native(odd_docs):
    plan = mixed_documents(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
