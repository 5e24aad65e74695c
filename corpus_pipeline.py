"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns the next one's docs; `run` writes each as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.decontaminate import drop_contaminated
from kelpline.llm.minhash import near_duplicates
from kelpline.llm.mixing import mixed_documents
from kelpline.llm.queries import table, tokenizer_path
from kelpline.llm.store import Workspace, quoted
from kelpline.llm.tokens import token_digests
from kelpline.llm.toxicity import keep_civil, train

#: No SQL: the ordinal model, the CGK embedding, the pivotal method and the tokenizer are beyond it (see tests/llm).
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the ordinal model calls toxic."""
    Workspace(spark, "toxicity")
    return keep_civil(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the least doc_id.

    Rows that repeat a kept doc_id are copies or versions of it: one of them stays. A null doc_id stays.
    """
    work = Workspace(spark, "near-dedup")
    found = work.save(near_duplicates(docs).select("doc_id", "kept"), "kept")
    columns = [quoted(c) for c in docs.columns]
    kept = docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(columns)
    twice = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(columns).union(once.select(columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that hold a benchmark item."""
    Workspace(spark, "contamination")
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix of sources says, 0 to 2 times."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token files; one row for each document in them."""
    return token_digests(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_files", token_files)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, f"{k}-{name}")
    return docs
