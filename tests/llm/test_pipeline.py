from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "token_files"]
    ids = {x.doc_id for x in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        now = {x.doc_id for x in out.select("doc_id").collect()}
        assert now <= ids and (k == 3 or out.groupBy("doc_id").count().filter("count > 1").isEmpty())
        docs, ids = out, now
    last = corpus_pipeline.token_files(spark, docs, SF)
    assert last.count() == docs.count()


def test_near_dedup_keeps_one_row_of_a_group(spark, odd_docs):
    kept = corpus_pipeline.near_dedup(spark, odd_docs, SF)
    got = sorted(x.doc_id for x in kept.filter(F.col("doc_id").isNotNull()).collect())
    assert got == [-5, 1, 2, 3, 5, 6, 10] and kept.filter("doc_id is null").count() == 2


def test_stages_keep_columns_of_any_name(spark, odd_docs, no_docs):
    """Names that look like internal ones, and one with a dot; nulls, empty and long texts; an empty table."""
    extra = {"__c": F.lit(7), "__k": F.col("doc_id"), "__i": F.lit("i"), "a.b": F.lit(1.5), "row": F.lit("r"), "i": F.lit(None).cast("string"), "copies": F.lit(3), "tick`": F.lit(4)}
    for docs, empty in ((odd_docs, False), (no_docs, True)):
        docs = docs.withColumns(extra)
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            rows = out.collect()
            assert empty == (not rows)
            assert all(r["__c"] == 7 and r["__k"] == r["doc_id"] and r["a.b"] == 1.5 and r["copies"] == 3 and r["i"] is None for r in rows), name
        assert (corpus_pipeline.token_files(spark, docs, SF).count() == 0) == empty


def test_run_over_the_small_tables(spark):
    """The five stages through Parquet: what is left is civil, without near copies and benchmark items, and as large as the mix says."""
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert set(taken) <= kept and max(taken.values()) <= 2
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
