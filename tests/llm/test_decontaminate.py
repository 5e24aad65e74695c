from __future__ import annotations

import random

import numpy as np

from kelpline.llm.decontaminate import ItemIndex, best_edits, contamination, drop_contaminated
from kelpline.llm.words import hash_words, terms_of

from .conftest import words


def edits(a: list, b: list) -> int:
    """Least edits between a and any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def planted(items, share, seed):
    r, out = random.Random(seed), []
    for n, (_, t) in enumerate(items):
        w = t.split()
        for _ in range(int(share * len(w))):
            q = r.randrange(len(w))
            kind = r.random()
            if kind < 0.5:
                w[q] = "zz%d" % r.randrange(10**6)
            elif kind < 0.75:
                del w[q]
            else:
                w.insert(q, "yy%d" % r.randrange(10**6))
        out.append((n, f"{words(r.randrange(60), n)} {' '.join(w)} {words(30, 900 + n)}"))
    return out


def test_recall_at_every_distance_and_exactness():
    items = [(i, words(15 + i % 45, 5000 + i)) for i in range(120)]
    index = ItemIndex([(i, t.encode()) for i, t in items])
    for share in (0, 0.05, 0.1, 0.2, 0.25):
        docs = planted(items, share, int(share * 100))
        got = {(docs[t][0], index.names[i][0]): e for t, i, e, _ in index.search([t.encode() for _, t in docs])}
        hit = 0
        for n, t in docs:
            want = edits(items[n][1].split(), [x.decode() for x in terms_of(t.encode())])
            if want <= int(0.25 * len(items[n][1].split())):
                hit += (n, n) in got
                assert got.get((n, n), want) >= want
        assert hit >= 0.97 * len(docs)
        assert all(a == b for a, b in got)


def test_best_edits_matches_brute_force():
    r = random.Random(1)
    for _ in range(60):
        a = [str(r.randrange(6)) for _ in range(7)]
        b = [str(r.randrange(6)) for _ in range(15)]
        x, y = (hash_words([w.encode() for w in s])[None, :] for s in (a, b))
        assert best_edits(x, y)[0][0] == edits(a, b)


def test_tables(spark, odd_docs, no_docs):
    items = [(1, words(40, 70)), (2, words(40, 70)), (3, "too short"), (None, words(30, 71)), (4, None), (5, ""), (6, words(25, 72))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, f"{words(50, 80)} {items[0][1].upper()}, {words(9, 81)}"), (2, words(100, 82)), (3, f"«{items[6][1]}»!"), (None, items[6][1]), (3, f"«{items[6][1]}»!")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted([(1, 1), (1, 2), (3, 6), (3, 6), (None, 6)], key=str)
    for limit in (1 << 20, 10):  # one pass, and many
        assert sorted(((x.doc_id, x.item_id) for x in contamination(docs, bench, pass_words=limit).collect()), key=str) == want
        assert [x.doc_id for x in drop_contaminated(docs, bench, pass_words=limit).collect()] == [2]
    clean = drop_contaminated(odd_docs, bench)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    assert contamination(no_docs, bench).collect() == [] and contamination(docs, bench.limit(0)).collect() == []
    assert drop_contaminated(docs, bench.limit(0)).count() == 5


def test_no_words_at_all():
    assert ItemIndex([]).search([b"a b c", None]) == [] and ItemIndex([(1, words(20, 1).encode())]).search([None, b"", b" "]) == []
    assert np.array_equal(ItemIndex([]).sizes, [])


def test_short_long_and_unspaced_items():
    """Items of under five words match word for word, Han and kana by character, and one long item does not widen the others."""
    import random

    r = random.Random(4)

    def text(n: int) -> str:
        return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    items = [(i, text(20)) for i in range(500)] + [(900, text(20_000)), (901, "short one"), (902, "こんにちは世界")]
    index = ItemIndex([(i, t.encode()) for i, t in items])
    texts = [f"{text(30)} {items[5][1]} short one x", "前こんにちは世界後", "one short", text(50)]
    found = [(t, index.names[i][0], e, s) for t, i, e, s in index.search([t.encode() for t in texts])]
    assert found == [(0, 5, 0, 30), (0, 901, 0, 50), (1, 902, 0, 1)]
