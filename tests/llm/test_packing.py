from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm.packing import Knapsack, Plan, best_fit, configurations, pack, packed_documents


def fewest(sizes: list[int], capacity: int) -> int:
    """The least number of sequences, by trying everything on few pieces."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(k: int, rooms: tuple) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[k]}:
            i = rooms.index(r)
            go(k + 1, (*rooms[:i], r - sizes[k], *rooms[i + 1 :]))
        go(k + 1, (*rooms, capacity - sizes[k]))

    go(0, ())
    return best


def placed(plan: Plan, histogram: dict[int, int], capacity: int) -> int:
    """Checks that every sequence is gapless and within capacity; the number of sequences."""
    held = defaultdict(list)
    for length, n in histogram.items():
        seq, off = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            held[s].append((o, length))
    for rows in held.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_plans_against_all_packings(sizes):
    histogram = dict(Counter(sizes))
    n = placed(Plan(histogram, 20), histogram, 20)
    assert n <= fewest(sizes, 20) + 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3), st.floats(0.1, 5)), min_size=1, max_size=4, unique_by=lambda x: x[0]))
def test_knapsack_against_all_multisets(items):
    items.sort()
    lengths, counts, prices = (np.array(x) for x in zip(*items, strict=True))
    sack = Knapsack(lengths, counts, prices, 24)
    sets = [((), 0, 0.0)]
    for k in range(len(items)):
        sets = [((*s, n), size + n * lengths[k], price + n * prices[k]) for s, size, price in sets for n in range(counts[k] + 1)]
    rooms = np.arange(25)
    row, col, times = sack.sets(rooms, lengths)
    for room in rooms:
        best = max(p for _, size, p in sets if size <= room)
        got = [(c, n) for r, c, n in zip(row, col, times, strict=True) if r == room]
        assert sum(lengths[c] * n for c, n in got) <= room and abs(sum(prices[c] * n for c, n in got) - best) < 1e-6 and abs(sack.best[room] - best) < 1e-6


@pytest.mark.parametrize("times", [1, 1000])
def test_near_the_bound_by_tokens(times):
    r = random.Random(1)
    histogram = Counter(min(4096, int(r.lognormvariate(6, 1)) + 1) for _ in range(20000))
    histogram = {k: n * times for k, n in histogram.items()}
    plan = Plan(histogram)
    bound = -(-sum(k * n for k, n in histogram.items()) // 4096)
    assert plan.sequences <= bound * 1.001 + 1
    assert (times > 1) or placed(plan, histogram, 4096) == plan.sequences
    lengths = np.array(sorted(histogram))
    chosen, left = configurations(lengths, np.array([histogram[int(k)] for k in lengths]), 4096)
    assert left.sum() < 0.7 * sum(histogram.values()) and len(plan.length) < 60_000  # the program does its share, and the plan doesn't grow
    assert sum(n for _, n in chosen) + sum(n for _, n in best_fit(lengths, left, 4096)) == plan.sequences


def test_awkward_lengths():
    """Two of 1400 and one of 1296 fill a sequence; three of 1365 leave one token; 3000 fits with nothing here."""
    histogram = {1400: 2000, 1296: 1000, 1365: 300, 3000: 50}
    assert placed(Plan(histogram), histogram, 4096) == 1000 + 100 + 50


def test_query_on_odd_documents(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    from kelpline.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in odd_docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packed_documents(odd_docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(held) == -(-sum(r.length for r in rows) // 4096)
    assert packed_documents(no_docs, tokenizer_path()).collect() == []


def test_a_common_length_is_sliced_and_reruns_agree(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "cast(0 AS int) AS piece", "0L AS start", "IF(id % 3 = 0, 100, 1 + id % 4096) AS length", "id AS ids_crc32", "'x' AS place_name")
    got = pack(rows).collect()
    assert sorted(got) == sorted(pack(rows.repartition(7)).collect())
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000 == len({r.doc_id for r in got})
