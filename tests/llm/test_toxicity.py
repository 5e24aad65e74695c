from __future__ import annotations

import random

from kelpline.llm.toxicity import fit, keep_civil, score_toxicity, train

from .conftest import words

BAD = ("grumbak", "snorvel", "plidwit", "dorfing")


def corpus(n: int, seed: int) -> list[tuple[int, str, int]]:
    r, out = random.Random(seed), []
    for i in range(n):
        w = words(r.randint(40, 120), seed * 10**6 + i).split()
        level = r.choice((0, 0, 0, 1, 2, 3))
        for _ in range({0: 0, 1: 2, 2: 5, 3: 12}[level]):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        out.append((i, " ".join(w), level))
    return out


def test_held_out_accuracy_and_order():
    model = fit([(t.encode(), int(y > 0)) for _, t, y in corpus(600, 1)])
    rows = corpus(400, 2)
    severity, p, grade = model.score([t.encode() for _, t, _ in rows])
    flagged = p >= model.cut
    assert sum(f == (y > 0) for f, (_, _, y) in zip(flagged, rows, strict=True)) >= 0.98 * len(rows)
    mean = [sum(s for s, (_, _, y) in zip(severity, rows, strict=True) if y == k) / sum(y == k for *_, y in rows) for k in range(4)]
    assert mean == sorted(mean) and (model.theta[1:] > model.theta[:-1]).all() and grade.max() == 3


def test_label_noise_and_near_copies_do_not_teach_plain_words():
    rows = [(t.encode(), int(y > 0)) for _, t, y in corpus(600, 3)]
    copy = words(150, 77).split()
    for i in range(60):
        copy[i % 150] = "v%d" % i
        rows.append((" ".join(copy).encode(), 1))
    model = fit(rows)
    _, p, _ = model.score([" ".join(copy).encode(), words(150, 78).encode()])
    assert p[1] < 0.5 and len(model.weights) <= 12


def test_training_from_tables(spark, odd_docs, no_docs):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(y > 0)) for i, _, y in rows] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = {x.doc_id: x for x in score_toxicity(docs, model).collect()}
    assert sum(got[i].toxic == (y > 0) for i, _, y in rows) >= 0.97 * len(rows)
    kept = keep_civil(docs, model)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i in got if not got[i].toxic}
    assert score_toxicity(odd_docs, model).count() == odd_docs.count() and keep_civil(odd_docs, model).columns == odd_docs.columns
    assert score_toxicity(no_docs, model).collect() == []
    blank = train(docs, labels.limit(0))
    assert not any(x.toxic for x in score_toxicity(docs, blank).collect())


def test_rare_toxic_terms_count_beside_common_ones():
    """Toxic terms by Zipf's law: documents that are toxic only by a rare term are found."""
    r = random.Random(9)
    bad = [f"zorb{i}x" for i in range(40)]
    rows = []
    for i in range(4000):
        w = words(60, 10**7 + i).split()
        y = int(r.random() < 0.3)
        for b in r.choices(bad, [1 / (k + 1) for k in range(40)], k=1) * 2 if y else ():
            w.insert(r.randrange(len(w)), b)
        rows.append((" ".join(w).encode(), y))
    model = fit(rows)
    _, p, _ = model.score([f"{words(40, 10**8 + k)} {b} {b} {words(30, 10**8 + 50 + k)}".encode() for k, b in enumerate(bad)])
    often = [sum(f" {b} " in f" {t.decode()} " for t, _ in rows) >= 12 for b in bad]
    assert sum(often) >= 18 and (p[often] >= model.cut).all()
    _, p, _ = model.score([words(80, 10**8 + 100 + k).encode() for k in range(50)])
    assert (p < model.cut).all()
