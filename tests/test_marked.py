"""Marked snippets against trying every stretch of words."""

from __future__ import annotations

import random
import re

from kelpline.operators.marked import marked_snippets


def brute(text, query, pad):
    words = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    pieces = re.findall(r"\w+|\W+", text or "")
    at = [sum(map(len, pieces[:k])) for k in range(len(pieces) + 1)]
    present = {p.lower() for p in pieces} & set(words)
    if not present:
        return None
    best = min((at[j + 1] - at[i], at[i], i, j) for i in range(len(pieces)) for j in range(i, len(pieces)) if present <= {p.lower() for p in pieces[i : j + 1]})
    _, start, i, j = best
    lo, hi = max(0, i - pad), min(len(pieces), j + pad + 1)
    body = "".join(f"«{p}»" if p.lower() in words else p for p in pieces[lo:hi])
    return len(present), start, start + best[0], "..." * (i - pad > 0) + body + "..." * (j + pad < len(pieces) - 1)


def test_marked_snippets_against_all_stretches(spark):
    r = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma", "x", "y1", "é", "zz", "of", "the"]
    texts = [(i, r.choice(["", "  ", "("]) + r.choice([" ", ", ", " - "]).join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 30])))) for i in range(50)]
    texts += [(100, None), (101, ""), (102, "nothing here")]
    queries = [(1, "alpha beta"), (2, "Gamma é of zz"), (3, "x"), (4, "absent"), (5, "")]
    hits = [(q, i, t, 0) for q, _ in queries for i, t in texts]
    for pad in (0, 3):
        df = spark.createDataFrame(hits, "query_id int, id int, body string, n int")
        got = {(x.query_id, x.id): (x.covered, x.start, x.stop, x.snippet) for x in marked_snippets(df, ["id"], "body", spark.createDataFrame(queries, "query_id int, query string"), pad).collect()}
        assert got == {(q, i): b for q, w in queries for i, t in texts if (b := brute(t, w, pad))}
