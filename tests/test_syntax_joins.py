from __future__ import annotations

from kelpline.operators import syntax


def test_tables_that_grow_with_the_sources_are_not_broadcast(spark):
    """Their files are a twentieth of their rows, so Spark's size check would send the tokens of 0.1 GB through the driver."""
    text = "import { a } from './lib';\nexport class Doc extends Base {\n  size = 1;\n  m() { this.size; f(); }\n}\nclass Base {}\nfunction f() {}\n"
    files = spark.createDataFrame([("a.ts", "typescript", text), ("b.ts", "typescript", text)], "path string, language string, content string")
    symbols, edges = syntax.extract(files)
    tokens = syntax._kept(syntax.token_table(files).filter("kind <> 'comment'"), "test-tokens")
    for df in (edges, syntax.symbols_of(tokens), syntax.calls_of(tokens, symbols), syntax.uses_of(tokens, symbols), syntax.heritage_of(tokens, symbols), syntax.imports_of(tokens)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["type"], r["confidence"]) for r in edges.collect()} >= {("EXTENDS", 0.95), ("CALLS", 1.0), ("ACCESSES", 0.8), ("IMPORTS", 0.6)}


def test_symbols_alone_make_nothing_of_the_relations(spark, monkeypatch):
    from kelpline.plans import code

    names, kept = [], syntax._kept
    monkeypatch.setattr(syntax, "_kept", lambda df, name: names.append(name) or kept(df, name))
    assert code.g11_symbols(spark, "/root/testdata/sf0.001").limit(1).count() == 1
    assert names and not {"heritage", "imports", "uses", "calls"} & set(names)


def test_token_streams_are_sorted_once_each_way(spark):
    rows = [("a.ts", "typescript", 0, "word", "f", 1, 1, -1, "", -1)]
    tokens = spark.createDataFrame(rows, "path string, language string, i int, kind string, text string, line int, end_line int, up int, around string, close int")
    plan = syntax._streams(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 2
