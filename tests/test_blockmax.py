"""The block index against plain BM25 over all postings, and how much of it a search reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kelpline.operators import blockmax, fts


def corpus(spark, n=3000):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.9)) % 4000}" for _ in range(60000)]
    rows = [(i, f"k{i % 7}", " ".join(r.choice(words) for _ in range(r.choice([1, 5, 20, 60, 120])))) for i in range(n)]
    rows += [(n, "k", "rare term"), (n + 1, "k", "rare term rare"), (n + 2, "k", None), (n + 3, "k", ""), (n + 4, None, "w1 w2 rare")]
    return spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, k string, text string, doc int").repartition(5)


def test_same_hits_as_all_postings_with_blocks_left_out(spark):
    docs = corpus(spark)
    q = spark.createDataFrame([(1, "rare term"), (2, "w20 w31"), (3, "w1 w5 w77 w311"), (4, "absent"), (5, ""), (6, "w9"), (7, "rare w3"), (8, None)], "query_id long, query string")
    index = blockmax.build(docs, ["doc_id"], "text")
    for limit in (3, 20):
        scores, blocks = blockmax.search(index, q, limit + 10)
        hits = lambda s: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5), r.phase) for r in fts.two_phase(s, ["doc_id"], limit).collect())
        assert hits(scores) == hits(fts.bm25(docs, ["doc_id"], "text", q))
    _, blocks = blockmax.search(index, q, 5)
    read = {r.query_id: (r.n, r.s) for r in blocks.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.col("scored").cast("int")).alias("s")).collect()}
    assert read[6][1] < 0.5 * read[6][0]  # one word: long documents can't reach the scores of short ones
    assert sum(s for _, s in read.values()) < 0.85 * sum(n for n, _ in read.values())


def test_empty_tables(spark):
    docs = corpus(spark, 5)
    q = spark.createDataFrame([(1, "rare")], "query_id long, query string")
    assert blockmax.search(blockmax.build(docs.limit(0), ["doc_id"], "text"), q, 5)[0].collect() == []
    assert blockmax.search(blockmax.build(docs, ["doc_id"], "text"), q.limit(0), 5)[0].collect() == []


def test_the_index_shuffles_texts_once_and_no_words(spark):
    docs = corpus(spark, 40)
    index = blockmax.build(docs, ["doc_id"], "text")
    shards = index.rows.filter("term = ''").select(F.size("length").alias("n")).collect()
    assert sum(r.n for r in shards) == docs.count()
    # A row for each term of a shard, not for each word in each block.
    terms = index.rows.filter("term <> ''").groupBy("shard", "term").count()
    assert terms.filter("count > 1").count() == 0 and index.rows.count() == terms.count() + len(shards)
