"""Diversity, snippets, lookups, receiver types and impact against plain Python versions and odd inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import diversity, graph, members, memory, skeleton, snippet


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def filled(seeds, candidates, files, sources):
    """What is added one candidate at a time: a pass over src/, then one over all."""
    have, out = set(seeds), []

    def enough():
        return (files is None or len(have) >= files) and sum(f.startswith("src/") for f in have) >= sources

    for only_src in (True,) if files is None else (True, False):
        for f in candidates:
            if enough():
                return out
            if f not in have and (f.startswith("src/") or not only_src):
                have.add(f)
                out.append(f)
    return out


@pytest.mark.parametrize("files", [4, None])
def test_fill_is_the_greedy_fill(spark, files):
    rng = random.Random(7)
    seeds, candidates, want = [], [], []
    for q in range(60):
        names = [f"{rng.choice(['src', 'lib'])}/{i}" for i in range(7)]
        s, c = rng.sample(names, rng.randint(1, 4)), [rng.choice(names) for _ in range(rng.randint(0, 12))]
        seeds += [(q, f) for f in s]
        candidates += [(q, f, i, i) for i, f in enumerate(c)]
        want += [(q, f) for f in filled(s, c, files, 3)]
    got = diversity.fill(spark.createDataFrame(seeds, "query_id int, file_path string"), spark.createDataFrame(candidates, "query_id int, file_path string, chunk_index int, position int"), files)
    assert rows(got.select("query_id", "file_path")) == sorted(want)


def test_explore_orders_by_source_then_words_then_score(spark):
    e = spark.createDataFrame([(1, "a/x.ts", "neighbor", 0.9), (1, "b/login.ts", "import", 0.1), (1, "c/y.ts", "import", 0.5), (1, "seed.ts", "import", 1.0), (1, "c/y.ts", "breadcrumb", 0.9)], "query_id int, file_path string, source string, score double")
    s = spark.createDataFrame([(1, "seed.ts")], "query_id int, file_path string")
    w = spark.createDataFrame([(1, ["login", "ts"])], "query_id int, words array<string>")
    got = diversity.explore(e, s, w).orderBy("rank").select("file_path", "priority").collect()
    assert [tuple(r) for r in got] == [("b/login.ts", "high"), ("c/y.ts", "high"), ("a/x.ts", "low")]


def window_by_steps(lines: list[str], words: list[str], room: int) -> str:
    """Takes a line above, then one below, as long as either fits."""
    score = [sum(w in x.lower() for w in words) for x in lines]
    shown = [score.index(max(score))]
    length = lambda a: len("\n".join(lines[k] for k in sorted(a)))
    while True:
        before = len(shown)
        for k in (min(shown) - 1, max(shown) + 1):
            if 0 <= k < len(lines) and length([*shown, k]) <= room:
                shown.append(k)
        if len(shown) == before:
            break
    text = "\n".join(lines[k] for k in sorted(shown))
    return "..." * (0 not in shown) + text + "..." * (len(lines) - 1 not in shown)


def test_text_around_the_best_line(spark):
    import random

    r = random.Random(2)
    rows = [(0, "k0", "crumb", "one\ntwo\nthree login user\nfour\nfive user"), (0, "k1", "c" * 300, "x" * 30), (0, "k2", None, None), (0, "k3", "p", "y" * 90)]
    rows += [(q, f"r{i}", "p" * r.choice([1, 20, 40]), "\n".join("".join(r.choice(["a", "b ", "login", "user", "zz"]) for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 25)))) for i in range(60) for q in (0, 1)]
    q = spark.createDataFrame([(0, "Login user"), (1, "zz")], "query_id long, query string")
    df = spark.createDataFrame([(*x, 1) for x in rows], "query_id long, k string, breadcrumb string, code string, n int")
    got = {(x.query_id, x.k): x.text for x in snippet.rerank_text(df, ["k"], q, 20, 60, 0.5).collect()}
    assert len(got) == len(rows)
    for query, k, crumb, code in rows:
        head = crumb or ""
        head = head if len(head) <= 20 else head[:8] + "..." + head[-8:]
        room, code, words = 60 - len(head) - 1, code or "", ["login", "user"] if query == 0 else ["zz"]
        if len(code) <= room:
            want = code
        elif any(w in code.lower() for w in words):
            want = window_by_steps(code.split("\n"), words, room)
        else:
            want = code[: room // 2] + "..." + code[len(code) - (room - room // 2 - 3) :]
        assert got[query, k] == head + "\n" + want, (code, room)


def test_cold_start(spark):
    f = spark.createDataFrame([("src/pay.ts", 9, "a\nb\nc\nd\nlogin\ne\nf\ng\nh\ni"), ("src/x.ts", 9, "pay Login"), ("n.ts", 9, None), ("big.ts", 10**9, "login"), ("e.ts", 0, "")], "path string, size long, content string")
    t = spark.createDataFrame([(1, 1, "login", False), (1, 0, "pay", True), (1, 2, "", False)], "query_id int, n int, term string, technical boolean")
    got = {r.path: r for r in snippet.cold_start(f, t).collect()}
    assert set(got) == {"src/pay.ts", "src/x.ts"}
    assert (got["src/x.ts"].score, got["src/x.ts"].token, got["src/x.ts"].text) == (25, "pay", "pay Login")
    assert (got["src/pay.ts"].score, got["src/pay.ts"].start_line, got["src/pay.ts"].end_line) == (15, 1, 5)


def test_impact_ends_on_cycles_and_empty_tables(spark):
    e = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"), ("c", "d", "Y")], "from_id string, to_id string, type string")
    s = spark.createDataFrame([("a",), ("z",)], "seed string")
    assert rows(graph.impact(e, s)) == [("a", "b", 1, "X"), ("a", "c", 2, "X"), ("a", "d", 3, "Y")]
    assert rows(graph.impact(e, s, 1)) == [("a", "b", 1, "X")]
    assert rows(graph.impact(e.limit(0), s)) == [] and rows(graph.impact(e, s.limit(0))) == []


def test_sources_of_imports(spark):
    cases = ["import a from './x'\nexport * from \"y\"", "from 'no'; import b; import c\n from ' z '; from 'late'", "", None]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(skeleton.sources_of("t").alias("s")).collect()
    assert [r.s for r in got] == [["./x", "y"], ["z"], [], None]


def test_receiver_types_follow_the_order_of_a_body(spark):
    scopes = spark.createDataFrame([("m", "c", "f")], "scope_id string, owner_id string, file_path string")
    props = spark.createDataFrame([("c", "p", "Declared", False), ("c", "p", "Built", True)], "owner_id string, name string, type_name string, constructed boolean")
    facts = spark.createDataFrame([("m", 1, "v", None, None, "this.p"), ("m", 2, "w", None, "make", None), ("m", 3, "this.p", None, None, "w"), ("m", 4, "u", None, "unknown", None)], "scope_id string, position int, key string, type_name string, callee string, value string")
    returns = spark.createDataFrame([("f", "make", "Made")], "file_path string, callee string, type_name string")
    assert rows(members.receiver_types(scopes, props, facts, returns)) == [("m", "this.p", "Made"), ("m", "v", "Built"), ("m", "w", "Made")]


def test_find_by_path_wants_one_file(spark):
    m = spark.createDataFrame([(1, "User Auth", "src/a", ["x.ts", "only.ts"]), (2, "b", "src/b/", ["x.ts"])], "id int, name string, dir string, files array<string>")
    asks = ["features/user-auth.json", "/src\\b\\x.ts", "x.ts", "only.ts", "b/x.ts", "c/x.ts"]
    got = memory.find_by_path(spark.createDataFrame(list(enumerate(asks)), "request_id int, path string"), m)
    assert sorted(((r.request_id, r.tier, r.id) for r in got.collect())) == [(0, "record", 1), (1, "exact", 2), (2, None, None), (3, "basename", 1), (4, "suffix", 2), (5, None, None)]


def test_pairs_and_base64url(spark):
    d = spark.createDataFrame([("a=1 | b = x=y |c| =z|a=2", "é?>" * 60), ("", ""), (None, None)], "p string, t string")
    got = d.select(T.pairs(d.p).alias("m"), T.base64url(d.t).alias("c"), T.from_base64url(T.base64url(d.t)).alias("t")).collect()
    assert [r.m for r in got] == [{"a": "2", "b": "x=y"}, {}, None]
    assert [r.t for r in got] == ["é?>" * 60, "", None] and not set("+/=\r\n") & set(got[0].c)


def test_column_functions_take_long_texts_in_proportion(spark):
    import time

    from kelpline.functions import text as T
    from kelpline.operators import contracts

    body = "return Response.json({ id: 1, 'x': y, a : { deep: 2 }, b: [json({ inner: 3 })] })\n"
    rows = [(body * 3000, "import x from './a'\n" * 20000, "k=v | " * 2000 + "k=w", r"C:\x\app\api\u\route.ts"), (None, None, None, None), ("", "", "", "")]
    df = spark.createDataFrame(rows, "t string, i string, p string, path string")
    began = time.perf_counter()
    got = df.select(contracts.response_keys(F.col("t")).alias("keys"), F.size(skeleton.sources_of("i")).alias("n"), T.pairs(F.col("p")).alias("m"), contracts.route_of(F.col("path")).alias("route")).collect()
    assert time.perf_counter() - began < 60
    assert (got[0]["keys"], got[0].n, got[0].m, got[0].route) == (["a", "b", "deep", "id", "inner"], 20000, {"k": "w"}, "/api/u")
    assert got[1]["keys"] is None and got[1].route is None and got[2]["keys"] == []


def test_advice_against_all_pairs(spark):
    """Copies, equal summaries under different titles, common and rare terms, nulls; a group of copies isn't paired with itself in full."""
    r = random.Random(7)
    words = ["common", "usual", *[f"rare{i}" for i in range(12)]]
    rows = []
    for i in range(160):
        title = " ".join(dict.fromkeys(r.choice(words[:2]) if r.random() < 0.5 else r.choice(words) for _ in range(r.randint(0, 6))))
        rows.append((i, r.choice(["p", "q", None]), title if i % 11 else None, r.choice(["s1", "S1 ", "s2", f"own{i}", None])))
    rows += [(1000 + i, "p", "common rare1 rare2", "s1") for i in range(60)]
    items = [(i, p, (t or "").split(), t, s) for i, p, t, s in rows]
    df = spark.createDataFrame(items, "id long, block string, terms array<string>, title string, summary string").repartition(3)
    want = {}
    for i, p, w, t, s in items:
        for j, q, v, u, z in items:
            both = len(set(w) & set(v))
            if i == j or p is None or p != q or not both:
                continue
            score = both / min(len(w), len(v)) + (0.18 if t is not None and u is not None and t.strip().lower() == u.strip().lower() else 0)
            score += (0.22 if s is not None and z is not None and s.strip().lower() == z.strip().lower() else 0) + (0.2 if both / (len(w) + len(v) - both) >= 0.8 else 0)
            if round(score, 6) >= 0.45:
                want.setdefault(i, []).append((-round(score, 6), j))
    got = {}
    for x in memory.advise(df, ["block"]).collect():
        got.setdefault(x.a_id, []).append((x["rank"], -round(x.score, 6), x.b_id))
    assert {i: [(s, j) for _, s, j in sorted(v)] for i, v in got.items()} == {i: sorted(v)[:3] for i, v in want.items()}


def test_advice_shuffles_no_pair_that_a_task_can_cut(spark):
    items = [(i, "p", [f"w{i % 3}", f"own{i}"], f"w{i % 3} own{i}", f"text {i} " + "long " * 50) for i in range(60)]
    df = spark.createDataFrame(items, "id long, block string, terms array<string>, title string, summary string")
    plan = memory.advise(df, ["block"])._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [a" in plan
