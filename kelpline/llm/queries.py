"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm.ann import nearest
from kelpline.llm.decontaminate import contamination
from kelpline.llm.minhash import near_duplicates
from kelpline.llm.mixing import mix_sources
from kelpline.llm.negatives import mine_negatives, stepped
from kelpline.llm.packing import packed_documents
from kelpline.llm.pii import find_personal_data
from kelpline.llm.runs import periodic_runs, run_digests, with_loops
from kelpline.llm.sitetree import main_text
from kelpline.llm.store import Workspace
from kelpline.llm.tokens import token_digests
from kelpline.llm.toxicity import score_toxicity, train
from kelpline.llm.warc import archive_records
from kelpline.llm.windows import repeated_passages


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    Workspace(spark, "toxicity")  # bounds the batches of texts
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_records(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "contamination")  # bounds the batches of texts
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stepped(table(spark, sf_dir, "embeddings"))
    return mine_negatives(vectors, vectors.filter("vec_id % 100 = 0"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    Workspace(spark, "runs")  # bounds the batches of texts
    docs = table(spark, sf_dir, "documents")
    return run_digests(periodic_runs(docs.withColumn("text", with_loops(F.col("text"), F.col("doc_id")))))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, s.doc_id = r.c AS kept
FROM sets s JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = s.doc_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT h, max(page_id) AS keeper FROM d GROUP BY h),
v AS (SELECT d.*, k.keeper, list_transform(range(0, 8), lambda g: CAST('0x' || substr(d.h, 5 * g + 1, 5) AS BIGINT)) AS q FROM d JOIN k ON k.h = d.h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((q[1 + i // 4] >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM v
"""

OP11_SQL = """
WITH r AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

QUERIES = {"op1_minhash_dedup": op1_minhash_dedup, "op2_mixing": op2_mixing, "op3_personal_data": op3_personal_data, "op4_main_text": op4_main_text, "op5_toxicity": op5_toxicity, "op6_nearest_neighbours": op6_nearest_neighbours, "op7_substring_dedup": op7_substring_dedup, "op8_token_files": op8_token_files, "op9_decontamination": op9_decontamination, "op10_warc": op10_warc, "op11_hard_negatives": op11_hard_negatives, "op12_packing": op12_packing, "op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op1_minhash_dedup": OP1_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL}
