"""Boundary cases of single operators on rows written by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kelpline.functions import intent, language
from kelpline.functions import text as T
from kelpline.operators import contracts, fts, fusion, graph, index, memory, symbols, telemetry
from kelpline.operators import imports as R
from kelpline.sources import diffs, logs
from kelpline.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rrf_merges_ranks_and_sources(spark):
    rows = [("q", "a", "vector", 0), ("q", "a", "lexical", 1), ("q", "b", "lexical", 0), ("q", "c", "skeleton", None)]
    got = {r.key: r for r in fusion.rrf(spark.createDataFrame(rows, "query_id string, key string, source string, rank int"), ["key"], {"vector": 0.6, "lexical": 0.4, "skeleton": 0.4}).collect()}
    assert got["a"].score == pytest.approx(0.6 / 20 + 0.4 / 21) and got["a"].source == "vector"
    assert got["b"].score == got["c"].score == pytest.approx(0.02) and got["c"].sources == ["skeleton"]


def cutoff(rows, ratio=0.5, delta=0.25, floor=0.25, min_k=2, max_k=8):
    rows = sorted(rows, key=lambda r: (-r[1], r[2]))
    if not rows or rows[0][1] < floor:
        return rows[:1]
    least, picked = max(floor, min(rows[0][1] * ratio, rows[0][1] - delta)), []
    for n, r in enumerate(rows):
        if len(picked) >= max_k or r[1] < (floor if n < min_k else least):
            break
        picked.append(r)
    out, seen = [], set()
    for r in picked + [r for r in rows if r not in picked and r[1] >= floor]:
        if r[0] not in seen and (r in picked or len(out) < min(min_k, max_k)):
            seen.add(r[0])
            out.append(r)
    return out


def test_smart_cutoff_matches_the_loop(spark):
    r = random.Random(6)
    rows = [(q, r.choice("abcdefgh"), round(r.choice((0.1, 0.2, 0.5, 1.0)) * r.random(), 3), p) for q in range(150) for p in range(r.randint(1, 14))]
    got = fusion.smart_cutoff(spark.createDataFrame(rows, "query_id int, key string, score double, position int"), ["key"]).collect()
    for q in range(150):
        own = [x[1:] for x in rows if x[0] == q]
        want = cutoff([(k, s, p) for k, s, p in own])
        assert sorted((x.key, x.score, x.position) for x in got if x.query_id == q) == sorted(want)


def test_pack_stops_at_the_first_overflow(spark):
    rows = [(1, "a", 0, 0.9, 30000), (1, "b", 0, 0.8, 20000), (1, "c", 0, 0.7, 10)]
    got = fusion.pack(spark.createDataFrame(rows, "query_id int, file_path string, start int, score double, length long")).collect()
    assert [x.file_path for x in got] == ["a"]


def test_merge_touching_intervals(spark):
    rows = [(1, 0, 5), (1, 5, 9), (1, 10, 12), (1, 1, 2), (2, 0, 1)]
    got = fusion.merge_intervals(spark.createDataFrame(rows, "g int, s int, e int"), ["g"], "s", "e").collect()
    assert sorted((x.g, x.s, x.e, x.merged) for x in got) == [(1, 0, 9, 3), (1, 10, 12, 1), (2, 0, 1, 1)]


def test_bm25_strict_rows_cannot_be_displaced(spark):
    docs = spark.createDataFrame([(1, "alpha beta " + "pad " * 300), (2, "alpha alpha"), (3, "beta beta beta"), (4, ""), (5, None)], "id int, text string")
    q = spark.createDataFrame([(0, "alpha beta"), (1, "missing"), (2, "")], "query_id int, query string")
    got = fts.two_phase(fts.bm25(docs, ["id"], "text", q), ["id"], 1).collect()
    assert [(x.query_id, x.id, x.phase) for x in got] == [(0, 1, "strict")]


def test_graph_cycles_end(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("b", "d", "IMPORTS")], "from_id string, to_id string, type string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert sorted((x.node, x.depth) for x in graph.impact(e, seeds, 5).collect()) == [("b", 1), ("c", 2), ("d", 2)]
    assert sorted(x.path for x in graph.simple_paths(e, seeds, 4).collect()) == [["a", "b", "d"]]


def test_classification_rules_in_order(spark):
    s = [("big", "h", 999, 1.0, "x", "go"), ("same", "h2", 5, 1.0, None, "go"), ("nul", "h", 5, 2.0, "a\0b", "go"), ("hash", "h1", 6, 2.0, "x", "go"), ("a-lock.json", "h", 5, 2.0, "x", "json"), ("new", "h", 5, 2.0, "x", "go"), ("mod", "h9", 5, 2.0, "x", "go")]
    k = [(p, "h1", 5, 1.0) for p in ("big", "same", "nul", "hash", "mod")]
    got = index.classify(spark.createDataFrame(s, "path string, hash string, size long, mtime double, content string, language string"), spark.createDataFrame(k, "path string, hash string, size long, mtime double"), 500).collect()
    assert {x.path: x.status for x in got} == {"big": "skipped", "same": "unchanged", "nul": "skipped", "hash": "unchanged", "a-lock.json": "skipped", "new": "added", "mod": "modified"}


def test_snapshots(spark, tmp_path):
    store = index.SnapshotStore(spark, f"file://{tmp_path}")
    assert store.current() is None
    for n in range(4):
        store.write(f"snap-{n}", {"t": spark.range(n + 1)})
        store.commit(f"snap-{n}", {"t": n + 1})
    assert store.current() == "snap-3" and store.read("t").count() == 4 and store.read("t", "snap-1").count() == 2
    with pytest.raises(ValueError):
        store.commit("snap-0", {"t": 5})
    assert len(store.prune(2)) == 2 and store.current() == "snap-3"


def test_rounding_and_rates(spark):
    assert one(spark, T.js_round(F.lit(-2.5))) == -2.0 and one(spark, T.js_round(F.lit(2.5))) == 3.0
    assert one(spark, T.ratio(F.lit(1), F.lit(0))) == 0.0
    none = spark.createDataFrame([], "x double")
    assert none.agg(telemetry.rate(F.col("x") > 1).alias("r")).first().r == 0.0
    assert none.agg(telemetry.percentile(F.col("x"), 0.95).alias("p")).first().p == 0.0
    assert spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double").agg(telemetry.percentile(F.col("x"), 0.95).alias("p")).first().p == 4.0


def test_alert_on_a_missing_metric(spark):
    m = spark.createDataFrame([("p", "a", 1.0)], "project string, metric string, value double")
    r = spark.createDataFrame([("down", "daemon", "==", 0.0, "warning", True), ("off", "daemon", "==", 0.0, "warning", False), ("a", "a", ">", 1.0, "x", True)], "rule_id string, metric string, operator string, threshold double, severity string, enabled boolean")
    assert [x.rule_id for x in telemetry.alerts(m, r).collect()] == ["down"]


@pytest.mark.parametrize(
    ("query", "terms", "want"),
    [("open src/app/main.ts", [], "navigation"), ("where is getUser", [], "symbol_lookup"), ("the service layer of search", [], "architecture"), ("how does it work", [], "conceptual"), ("plain words", [], "balanced"), ("plain words", ["X"], "symbol_lookup"), ("handler and adapter of it", ["X"], "architecture")],
)
def test_intents(spark, query, terms, want):
    arr = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    assert one(spark, intent.intent(F.lit(query), arr)) == want


def test_text_functions(spark):
    assert one(spark, T.identifier_variants(F.lit("getUserName"))) == ["getusername", "get_user_name", "getUserName"]
    assert one(spark, T.truncate_middle(F.lit("abcdefghij"), 7)) == "ab...ij" and one(spark, T.slug(F.lit(" A b--C! "))) == "a-b-c"
    assert one(spark, T.overlap_score(F.lit("User users"), F.array(F.lit("user"), F.lit("ser"), F.lit("zzz")))) == 1.5
    assert one(spark, T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    assert one(spark, language.language(F.lit("a/b.PY"))) == "python" and one(spark, language.ignored(F.lit("x/node_modules/y.ts")))
    assert one(spark, memory.path_matches(F.lit("src/a/b.ts"), F.lit("src/**/b.ts"))) and not one(spark, memory.path_matches(F.lit("src/ab.ts"), F.lit("src/a")))


def test_diffs(spark):
    text = ["diff --git a/x b/x", "+++ b/x.ts", "@@ -1,2 +3,2 @@ f()", "+a", "@@ -9 +12 @@", "@@ -20,1 +20,0 @@", "+++ /dev/null", "@@ -1 +1 @@"]
    got = diffs.changed_lines(spark.createDataFrame([(1, n, t) for n, t in enumerate(text)], "diff_id int, n int, line string")).collect()
    assert sorted((x.file_path, x.line) for x in got) == [("x.ts", 3), ("x.ts", 4), ("x.ts", 12)]


def test_log_lines(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        (tmp_path / f"app.{day}.log").write_text(f'x done {{"requestId":"{day}","timingMs":{{"recall":1}}}}\nx done {{bad\nnothing\n')
    lines = logs.read_directory(spark, f"file://{tmp_path}", 2)
    got = logs.parse_lines(lines, "value", ["done"]).collect()
    assert sorted(x.request_id for x in got) == ["2024-01-02", "2024-01-03"] and got[0].recall == 1.0 and got[0].rerank == 0.0


def test_imports_and_contracts(spark):
    files = spark.createDataFrame([(p, c) for p, c in (("src/a/b.ts", "fetch('/api/x')"), ("src/a/c/index.ts", ""), ("app/pkg/m.py", ""), ("lib/pkg/m.py", ""), ("src/r.ts", "fetch('/api/x')"))], "path string, content string")
    want = [(1, "typescript", "src/a/c", "../b"), (2, "typescript", "src/a", "./c"), (3, "typescript", "src/a", "react"), (4, "python", "lib/z", "pkg.m"), (5, "typescript", "src", "./a/b.js"), (6, "typescript", "src", "./gone")]
    got = {x.import_id: x.target for x in R.resolve(spark.createDataFrame(want, "import_id int, language string, folder string, name string"), files).collect()}
    assert got == {1: "src/a/b.ts", 2: "src/a/c/index.ts", 4: "lib/pkg/m.py", 5: "src/a/b.ts"}
    routes = spark.createDataFrame([("/api/x", "src/r.ts")], "route string, file_path string")
    assert [tuple(x) for x in contracts.consumers(routes, files).collect()] == [("/api/x", "src/a/b.ts")]


def test_symbols_of_broken_sources():
    assert symbols.python_rows("a.py", "def f(:") == [] and symbols.line_rows("a.ts", "") == []
    kinds = [(r[1], r[2], r[4]) for r in symbols.python_rows("a.py", "class A(B):\n    def f(self):\n        return g()\n")]
    assert kinds == [("Class", "A", None), ("EXTENDS", "A", "B"), ("Method", "f", None), ("CALLS", None, "g")]


def test_line_splitter_covers_every_text(spark):
    r = random.Random(2)
    texts = {i: "\n".join("x" * r.randrange(0, 90) for _ in range(r.randrange(1, 40))) for i in range(40)} | {100: "", 101: "y" * 5000}
    got = {}
    for x in memory.split_lines(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text", 200).collect():
        got.setdefault(x.id, []).append((x.chunk_index, x.start, x.end))
    for i, t in texts.items():
        parts = sorted(got[i])
        assert "\n".join(t[a:b] for _, a, b in parts) == t
        assert all(len(t[a:b].replace("\n", "")) <= 200 or "\n" not in t[a:b] for _, a, b in parts)


def test_mmr_prefers_different_items(spark):
    rows = [("q", 1, 1.0, ["a", "b"]), ("q", 2, 0.99, ["a", "b"]), ("q", 3, 0.5, ["c"]), ("q", 4, 0.1, ["d"])]
    got = memory.mmr(spark.createDataFrame(rows, "query_id string, id int, relevance double, terms array<string>"), 2, 0.6).orderBy("position").collect()
    assert [x.id for x in got] == [1, 3]


def test_active_tasks_stream(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:05:00"), ("k2", "2024-01-01 00:06:00")]
    spark.createDataFrame(rows, "dedupe_key string, created_at string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("dedupe_key string, created_at string").parquet(f"{tmp_path}/in")
    events.run_once(events.active_tasks(stream), "active", "append", f"file://{tmp_path}/check")
    assert sorted(x.dedupe_key for x in spark.table("active").collect()) == ["k1", "k2"]


def test_fallback_is_by_query(spark):
    first = spark.createDataFrame([(1, "a")], "query_id int, path string")
    second = spark.createDataFrame([(1, "b"), (2, "c")], "query_id int, path string")
    assert sorted(map(tuple, fusion.fallback(first, second).collect())) == [(1, "a"), (2, "c")]


def test_overlap_of_terms_with_other_characters(spark):
    """Whole tokens are looked up among the tokens of the text, other terms by what is around them."""
    text = F.lit("see a.b and xa.b, naïve")
    assert one(spark, T.overlap_score(text, F.array(F.lit("a.b"), F.lit("naïve"), F.lit("na")))) == 2.5
    assert one(spark, T.overlap_score(text, F.array(F.lit("b, na"), F.lit("absent")))) == 0.5


def test_neighbours_of_the_items_alone(spark, tmp_path, monkeypatch):
    """Query vectors that are no item never meet the vectors."""
    from kelpline.plans import retrieval as Q

    spark.range(200).selectExpr("id AS vec_id", "array(cast(id AS float), 1f) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = []
    knn = Q.vector.knn
    monkeypatch.setattr(Q.vector, "knn", lambda v, q, k: asked.append(q.count()) or knn(v, q, k))
    items = spark.createDataFrame([(0,), (40,), (41,)], "query_id long")
    assert {r.query_id for r in Q.vector_hits(spark, str(tmp_path), items).collect()} == {0, 40} and asked == [2]
