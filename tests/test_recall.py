"""Graph recall against a plain walk over a small graph."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from kelpline.operators.recall import graph_chunks, graph_recall


def walk(terms, symbols, edges, calls, chunks, top, per_file):
    by_id, out = {s[0]: s for s in symbols}, []
    for q in {t[0] for t in terms}:
        matched = {}
        for _, term in {t for t in terms if t[0] == q and t[1]}:
            for i, name, _ in symbols:
                if name == term:
                    matched[i] = 1.0
            worded = sorted((len(n), i) for i, n, _ in symbols if n and term in n.lower().split())
            for _, i in worded[:top]:
                matched.setdefault(i, 0.8)
        ways = [(i, s) for i, s in matched.items()]
        ways += [(b, s * 0.75) for i, s in matched.items() for a, b in [*edges, *((y, x) for x, y in edges)] if a == i]
        ways += [(c, s * 0.7) for i, s in matched.items() for c, t in calls if t == i]
        files = defaultdict(list)
        for i, s in ways:
            if i in by_id:
                files[by_id[i][2]].append((by_id[i][1].lower(), s))
        for path, found in files.items():
            counts = Counter({k: sum(n in f"{b or ''}\n{c or ''}".lower() for n, _ in found) for p, k, b, c in chunks if p == path})
            for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:per_file]:
                if n:
                    out.append((q, path, k, round(max(s for _, s in found), 6), n))
    return sorted(out)


def test_graph_recall_against_a_walk(spark):
    r = random.Random(3)
    words = ["load", "Save", "user", "index", "queue", "chunk"]
    symbols = [(f"s{i}", " ".join(r.sample(words, r.choice([1, 2, 3]))), f"f{i % 5}.ts") for i in range(40)]
    edges = [(f"s{r.randrange(45)}", f"s{r.randrange(45)}") for _ in range(50)] + [(None, "s1")]
    calls = [(f"s{r.randrange(45)}", f"s{r.randrange(40)}") for _ in range(30)] + [("s1", None)]
    chunks = [(f"f{p}.ts", k, r.choice([None, "crumb User"]), " / ".join(r.choice(symbols)[1] for _ in range(3)) if k else None) for p in range(6) for k in range(5)]
    terms = [(1, "load"), (1, "Save"), (2, "user"), (2, "user"), (3, "absent"), (4, None), (5, "index"), (5, "queue"), (5, "chunk")]
    df = lambda rows, schema: spark.createDataFrame([(*x, "x") for x in rows], schema + ", note string")
    for top, per_file in ((3, 2), (20, 3)):
        got = graph_recall(df(terms, "query_id int, term string"), df(symbols, "id string, name string, file_path string"), df(edges, "from_id string, to_id string"), df(calls, "caller_id string, target_id string"), df(chunks, "file_path string, chunk_index int, breadcrumb string, code string"), top, per_file)
        assert sorted((x.query_id, x.file_path, x.chunk_index, x.score, x.named) for x in got.collect()) == walk(terms, symbols, edges, calls, chunks, top, per_file)


def test_the_ways_to_names_are_joined_once(spark):
    related = spark.createDataFrame([(1, "Alpha", "f", 1.0), (1, "beta", "f", 0.8)], "query_id int, name string, file_path string, score double")
    chunks = spark.createDataFrame([("f", 0, None, "alpha beta"), ("f", 1, None, "beta")], "file_path string, chunk_index int, breadcrumb string, code string")
    got = graph_chunks(related, chunks)
    assert sorted((r.chunk_index, r.named, r.score) for r in got.collect()) == [(0, 2, 1.0), (1, 1, 1.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # of the chunks alone
