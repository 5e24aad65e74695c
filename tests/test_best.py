from __future__ import annotations

from pyspark.sql import functions as F

from kelpline.operators import best, fts


def test_the_best_of_blocks_are_the_best_of_all_and_few(spark, monkeypatch):
    rows = [(i, f"alpha w{i % 7} " + "beta " * (i % 5) + "pad " * (i % 11)) for i in range(400)]
    rows += [(3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta x"), (None, "beta x y"), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    q = spark.createDataFrame([(0, "alpha beta"), (1, "alpha w3 pad"), (2, "missing"), (3, ""), (4, None)], "query_id int, query string")
    monkeypatch.setattr(best, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(best, "PART", 1)
    hits = lambda scored, limit: sorted(map(str, fts.two_phase(scored, ["id"], limit).collect()))
    whole = fts.bm25(docs, ["id"], "text", q)
    for limit in (1, 5):
        few = best.bm25_best(docs, ["id"], "text", q, limit + 10)
        assert hits(few, limit) == hits(whole, limit)
    assert best.bm25_best(docs, ["id"], "text", q, 1).count() <= 2 * 10 * 2 < whole.count()


def test_equal_scores_and_no_rows(spark):
    docs = spark.createDataFrame([(i, 0, "alpha") for i in range(500)], "id int, part int, text string")
    q = spark.createDataFrame([("a", "alpha")], "query_id string, query string")
    got = fts.two_phase(best.bm25_best(docs, ["id", "part"], "text", q, 13), ["id", "part"], 3).collect()
    assert sorted((r["rank"], r.id) for r in got) == [(0, 0), (1, 1), (2, 2)]
    assert best.bm25_best(docs.limit(0), ["id"], "text", q, 3).count() == best.bm25_best(docs, ["id"], "text", q.limit(0), 3).count() == 0


def test_pieces_of_texts_are_cut_behind_the_shuffle(spark):
    texts = spark.createDataFrame([(f"f{i}", "\n".join(f"alpha w{(i + j) % 7} " + "beta " * (j % 3) for j in range(i % 9))) for i in range(60)] + [("x", None), ("y", "")], "path string, content string")
    q = spark.createDataFrame([(0, "alpha beta"), (1, "w3 beta"), (2, "missing")], "query_id int, query string")
    seen = []

    def cut(d):
        seen.append(d._jdf.queryExecution().analyzed().toString())
        return d.select("*", F.posexplode(F.split("content", "\n")).alias("n", "line"))

    key = ["path", "n"]
    hits = lambda scored: sorted(map(str, fts.two_phase(scored, key, 5).collect()))
    assert hits(best.bm25_best(texts, key, "line", q, 15, cut=cut, whole="content")) == hits(fts.bm25(cut(texts), key, "line", q))
    assert "Repartition" in seen[0] and "Repartition" not in seen[1]
