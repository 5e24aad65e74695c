"""Words of text without blanks: a table of boundaries, and such words found inside sentences."""

from __future__ import annotations

from kelpline.functions.text import query_segments, segments, tokens
from kelpline.operators import fts

TABLE = [
    ("Hello World_1", ["hello", "world_1"], ["hello", "world_1"]),
    ("检索", ["检", "检索", "索"], ["检索"]),
    ("重建检索索引v2", ["重", "重建", "建", "建检", "检", "检索", "索", "索索", "索", "索引", "引", "v2"], ["重建", "建检", "检索", "索索", "索引", "v2"]),
    ("カタカナとABC", ["カ", "カタ", "タ", "タカ", "カ", "カナ", "ナ", "ナと", "と", "abc"], ["カタ", "タカ", "カナ", "ナと", "abc"]),
    ("サーバー", ["サ", "サー", "ー", "ーバ", "バ", "バー", "ー"], ["サー", "ーバ", "バー"]),
    ("한국어 텍스트", ["한국어", "텍스트"], ["한국어", "텍스트"]),
    ("é ñandú", ["é", "ñandú"], ["é", "ñandú"]),
    ("字", ["字"], ["字"]),
    ("", [], []),
    (None, None, None),
]


def test_boundaries(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TABLE)], "n int, t string")
    got = df.select("n", segments(df.t).alias("s"), query_segments(df.t).alias("q"), tokens(df.t).alias("t")).orderBy("n").collect()
    assert [(r.s, r.q) for r in got] == [(s, q) for _, s, q in TABLE]
    assert got[0].s == got[0].t and got[5].s == got[5].t and got[6].s == got[6].t


def test_a_word_inside_a_sentence_is_found(spark):
    docs = spark.createDataFrame([(1, "我们需要重建检索索引以后再试"), (2, "検索サーバーを再起動する"), (3, "rebuild the index"), (4, "检查引用"), (5, None)], "id int, text string")
    q = spark.createDataFrame([(1, "检索"), (2, "サーバー"), (3, "index"), (4, "索引 rebuild")], "query_id int, query string")
    hits = {(r.query_id, r.id, r.matched == r.n_terms) for r in fts.bm25(docs, ["id"], "text", q, unspaced=True).collect()}
    assert hits == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False), (4, 3, False)}
    assert not [r for r in fts.bm25(docs, ["id"], "text", q).collect() if r.query_id in (1, 2)]  # whole runs alone find nothing
