"""Index maintenance queries: scans, classification, deltas, upserts, retention, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import language as L
from kelpline.functions import text as T
from kelpline.operators import bucketed
from kelpline.operators import index as I
from kelpline.plans.registry import Family
from kelpline.sources import fixtures as X
from kelpline.sources.store import shared_path

family = Family()
FK = {"f": X.files, "k": X.known_files}
BASE = f"{X.FILES}, {X.KNOWN}"

_PATHS = "SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' ELSE 'a/b/' END, cast(doc_id AS string), '.', element_at(array('ts', 'py', 'bin', 'MD', 'json', 'rs'), cast(doc_id % 6 + 1 AS int))) AS path FROM {d}"
_PATHS_SQL = "p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/' ELSE 'a/b/' END || doc_id || '.' || (['ts', 'py', 'bin', 'MD', 'json', 'rs'])[doc_id % 6 + 1] AS path FROM documents)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PATHS, d=X.load(spark, sf_dir, "documents"))


@family.add("sc2_ignore_filter", f"WITH {_PATHS_SQL} SELECT path FROM p WHERE path NOT LIKE 'node_modules/%' AND doc_id % 6 <> 2")
def sc2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).filter(L.allowed(F.col("path"))).select("path")


@family.add("sc3_language_map", f"WITH {_PATHS_SQL} SELECT path, (['typescript', 'python', 'unknown', 'markdown', 'json', 'rust'])[doc_id % 6 + 1] AS language FROM p")
def sc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("path", L.language(F.col("path")).alias("language"))


@family.add("sc4_charset_decode", "SELECT doc_id, md5(text) AS digest FROM documents")
def sc4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes in three encodings, decoded by their marks."""
    d = X.load(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    b = d.select("doc_id", raw.alias("raw"))
    return b.select("doc_id", F.md5(L.decode_text(F.col("raw"))).alias("digest"))


_TIMES = "CASE WHEN doc_id % 10 = 2 THEN 1.0 ELSE 2.0 END"
STATUS = f"""{BASE}, st AS (SELECT f.path, f.size, CASE WHEN f.size > 20000 THEN 'skipped' WHEN k.hash IS NOT NULL AND f.doc_id % 10 = 2 AND k.size = f.size THEN 'unchanged' WHEN k.hash = f.hash THEN 'unchanged'
  WHEN k.hash IS NULL THEN 'added' ELSE 'modified' END AS status FROM files f LEFT JOIN known k ON k.path = f.path)"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir).withColumn("mtime", F.lit(1.0))
    k = X.known_files(spark, sf_dir).withColumn("mtime", F.when(F.col("doc_id") % 10 == 2, 1.0).otherwise(2.0))
    return I.classify(f, k, 20000)


@family.add("sc5_file_classification", f"WITH {STATUS} SELECT * FROM st")
def sc5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir)


family.sql("sc6_file_metadata", FK, "SELECT path, hash, size, language FROM {f}", f"WITH {X.FILES} SELECT path, hash, size, language FROM files")
family.sql(
    "sc7_multi_file_chunk_fetch", {"c": X.chunks, "k": X.known_files}, "SELECT path, chunk_index, length(code) AS n FROM {c} LEFT SEMI JOIN (SELECT path AS p FROM {k} WHERE vector_index_hash = 'stale') ON path = p",
    f"WITH {X.CHUNKS}, {X.KNOWN} SELECT path, chunk_index, length(code) AS n FROM chunks WHERE path IN (SELECT path FROM known WHERE vector_index_hash = 'stale')",
)
family.sql(
    "sc8_text_payload_bytes", {"c": X.chunks}, "SELECT count(*) AS n, sum(octet_length(coalesce(code, ''))) AS code_bytes, sum(octet_length(breadcrumb)) AS crumb_bytes FROM {c}",
    f"WITH {X.CHUNKS} SELECT count(*) AS n, CAST(sum(octet_length(encode(coalesce(code, '')))) AS BIGINT) AS code_bytes, CAST(sum(octet_length(encode(breadcrumb))) AS BIGINT) AS crumb_bytes FROM chunks",
)
family.sql(
    "a20_storage_stats", {"f": X.files}, "SELECT language, count(*) AS n, sum(size) AS bytes, sum(size) - sum(CASE WHEN first THEN size ELSE 0 END) AS duplicated FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) = 1 AS first FROM {f}) GROUP BY language",
    f"WITH {X.FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path) = 1 AS first_ FROM files) SELECT language, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) - sum(CASE WHEN first_ THEN size ELSE 0 END) AS BIGINT) AS duplicated FROM r GROUP BY language",
)
family.sql(
    "a21_index_coverage", {"c": X.chunks, "k": X.known_files}, "SELECT count(*) AS chunks, count_if(k.path IS NOT NULL) AS indexed, round(count_if(k.path IS NOT NULL) / count(*), 6) AS coverage FROM {c} c LEFT JOIN {k} k ON k.path = c.path AND k.vector_index_hash = c.hash",
    f"WITH {X.CHUNKS}, {X.KNOWN} SELECT count(*) AS chunks, count(k.path) AS indexed, round(count(k.path) / count(*), 6) AS coverage FROM chunks c LEFT JOIN known k ON k.path = c.path AND k.vector_index_hash = c.hash",
)


@family.add(
    "a22_update_plan",
    f"""WITH {STATUS}, g AS (SELECT count(*) AS deleted, coalesce(sum(k.size), 0) AS b FROM known k WHERE k.path NOT IN (SELECT path FROM files)), h AS (SELECT count(*) AS healing, coalesce(sum(size), 0) AS b FROM known WHERE vector_index_hash IS DISTINCT FROM hash AND path IN (SELECT path FROM files)),
s AS (SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'skipped') AS skipped, coalesce(sum(size) FILTER (WHERE status IN ('added', 'modified')), 0) AS b, count(*) AS total FROM st),
x AS (SELECT added, modified, unchanged, skipped, deleted, healing, (added + modified + deleted + healing) / total AS churn, (s.b + g.b + h.b) / greatest((SELECT sum(size) FROM files), s.b + g.b + h.b) AS cost, total >= 8 AND added + modified + deleted + healing >= 5 AS able FROM s, g, h)
SELECT added, modified, unchanged, skipped, deleted, healing, round(churn, 6) AS churn_ratio, round(cost, 6) AS cost_ratio, CASE WHEN able AND (churn >= 0.35 OR cost >= 0.65) THEN 'full' WHEN added + modified + deleted + healing > 0 THEN 'incremental' ELSE 'none' END AS mode FROM x""",
)
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = X.files(spark, sf_dir), X.known_files(spark, sf_dir)
    return I.plan(statuses(spark, sf_dir), I.deleted(f, k), I.healing(f, k), f)


@family.add("a23_scan_stat_merge", f"WITH {STATUS} SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM st GROUP BY status")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statuses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@family.add("j6_deleted_paths", f"WITH {BASE} SELECT path, size FROM known WHERE path NOT IN (SELECT path FROM files)")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.deleted(X.files(spark, sf_dir), X.known_files(spark, sf_dir)).select("path", "size")


@family.add("sk8_self_heal_set", f"WITH {BASE} SELECT path, hash, vector_index_hash FROM known WHERE vector_index_hash IS DISTINCT FROM hash AND path IN (SELECT path FROM files)")
def sk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.healing(X.files(spark, sf_dir), X.known_files(spark, sf_dir)).select("path", "hash", "vector_index_hash")


@family.add(
    "sk1_upsert_files",
    f"WITH {BASE} SELECT path, hash, CASE WHEN octet_length(encode(content)) <= 5000 THEN md5(content) END AS content FROM files UNION ALL SELECT path, hash, NULL FROM known WHERE path NOT IN (SELECT path FROM files)",
)
def sk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.known_files(spark, sf_dir).select("path", "hash", F.lit(None).cast("string").alias("content"))
    return I.upsert(old, X.files(spark, sf_dir).select("path", "hash", "content"), ["path"], "content", 5000).withColumn("content", F.md5("content"))


@family.add(
    "sk2_version_swap",
    f"WITH {BASE}, v AS (SELECT path, hash, 1 AS version FROM known UNION ALL SELECT path, hash, 2 FROM files) SELECT path, hash, version FROM v QUALIFY dense_rank() OVER (PARTITION BY path ORDER BY version DESC) = 1",
)
def sk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.known_files(spark, sf_dir).select("path", "hash", F.lit(1).alias("version")).union(X.files(spark, sf_dir).select("path", "hash", F.lit(2)))
    return I.newest_version(v, ["path"], [F.col("version").desc()])


@family.add(
    "sk3_cascading_delete",
    f"WITH {X.CHUNKS}, {X.KNOWN}, g AS (SELECT path FROM files WHERE doc_id % 10 = 4) SELECT 'chunks' AS name, count(*) AS n FROM chunks WHERE path NOT IN (SELECT path FROM g) UNION ALL SELECT 'known', count(*) FROM known WHERE path NOT IN (SELECT path FROM g)",
)
def sk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = X.files(spark, sf_dir).filter("doc_id % 10 = 4")
    left = I.cascade_delete(gone, "path", {"chunks": X.chunks(spark, sf_dir), "known": X.known_files(spark, sf_dir)})
    a, b = (t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items())
    return a.union(b)


_TERMS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"


@family.add(
    "sk4_replace_postings",
    f"WITH {X.FILES}, w AS (SELECT path, hash, unnest({_TERMS}) AS term FROM files) SELECT path, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM (SELECT path, term, count(*) AS tf FROM w GROUP BY path, term) GROUP BY path",
)
def sk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of changed files are recomputed and replace theirs; the others stay."""
    from kelpline.operators.fts import postings

    f = X.files(spark, sf_dir)
    changed = F.col("doc_id") % 5 == 0
    old = postings(f.withColumn("content", F.when(changed, F.lit("old text")).otherwise(F.col("content"))), ["path"], "content")
    new = postings(f.filter(changed), ["path"], "content")
    merged = old.join(f.filter(changed).select("path"), "path", "left_anti").unionByName(new)
    return merged.groupBy("path").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


family.sql(
    "sk5_fts_rebuild_set", FK, "SELECT f.path, f.hash FROM {f} f LEFT SEMI JOIN {k} k ON k.path = f.path AND k.vector_index_hash = f.hash",
    f"WITH {BASE} SELECT f.path, f.hash FROM files f WHERE EXISTS (SELECT 1 FROM known k WHERE k.path = f.path AND k.vector_index_hash = f.hash)",
)
family.sql(
    "sk6_count_driven_resync", FK, "SELECT (SELECT count(*) FROM {k}) AS indexed, (SELECT count(*) FROM {f}) AS files, (SELECT count(*) FROM {k}) < (SELECT count(*) FROM {f}) AS rebuild",
    f"WITH {BASE} SELECT (SELECT count(*) FROM known) AS indexed, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM known) < (SELECT count(*) FROM files) AS rebuild",
)
family.sql(
    "sk7_fts_metadata_enrich", {"c": X.chunks, "s": X.symbols}, "SELECT c.path, c.chunk_index, c.language, coalesce(x.symbols, '') AS symbols FROM {c} c LEFT JOIN (SELECT start_line, concat_ws(' ', array_sort(collect_set(name))) AS symbols FROM {s} WHERE type = 'Function' GROUP BY start_line) x ON x.start_line = c.chunk_index",
    f"WITH {X.CHUNKS}, {X.SYMBOLS}, x AS (SELECT start_line, array_to_string(list_sort(list_distinct(list(name))), ' ') AS symbols FROM symbols WHERE type = 'Function' GROUP BY start_line) SELECT c.path, c.chunk_index, c.language, coalesce(x.symbols, '') AS symbols FROM chunks c LEFT JOIN x ON x.start_line = c.chunk_index",
)
family.sql(
    "sk9_partition_overwrite", {"s": X.symbols}, "SELECT file_path, id, 'new' AS state FROM {s} WHERE file_path LIKE '%/7.ts' AND exported UNION ALL SELECT file_path, id, 'old' FROM {s} WHERE file_path NOT LIKE '%/7.ts'",
    f"WITH {X.SYMBOLS} SELECT file_path, id, 'new' AS state FROM symbols WHERE file_path LIKE '%/7.ts' AND exported UNION ALL SELECT file_path, id, 'old' FROM symbols WHERE file_path NOT LIKE '%/7.ts'",
)


@family.add(
    "sk9_bucketed_overwrite",
    f"WITH {X.SYMBOLS} SELECT file_path, id, 'new' AS state FROM symbols WHERE file_path LIKE '%/7.ts' AND exported UNION ALL SELECT file_path, id, 'old' FROM symbols WHERE file_path NOT LIKE '%/7.ts'",
)
def sk9_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in a bucketed table on disk; those of changed files take the old ones' place, and the table is read back."""
    s = X.symbols(spark, sf_dir).select("file_path", "id", F.lit("old").alias("state"), "exported")
    path = shared_path(spark, "symbols-by-file")
    table = s.drop("exported")
    bucketed.create(table, path, "file_path", 32)
    changed = s.filter("file_path LIKE '%/7.ts'")
    bucketed.replace(spark, path, "file_path", 32, changed.select("file_path"), changed.filter("exported").select("file_path", "id", F.lit("new").alias("state")))
    return bucketed.read(spark, path, table.schema)


@family.add(
    "sk10_snapshot_retention",
    "SELECT o_custkey AS project_id, o_orderkey AS snapshot_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5 OR o_orderkey % 97 = 0",
)
def sk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("mtime"))
    return I.retained(s, 5, F.col("snapshot_id") % 97 == 0).select("project_id", "snapshot_id")


@family.add(
    "sk11_keyed_last_write_wins",
    "SELECT substr(md5('/home/' || o_custkey), 1, 10) AS project_id, last(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS priority, count(*) AS writes FROM orders GROUP BY o_custkey",
)
def sk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.load(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("/home/"), F.col("o_custkey").cast("string")))
    g = o.groupBy("path").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"), F.count("*").alias("writes"))
    return g.select(T.project_id(F.col("path")).alias("project_id"), "priority", "writes")


family.sql(
    "sk12_identity_repair", {"c": lambda s, d: X.load(s, d, "customer")}, "SELECT canonical, c_mktsegment AS name, c_custkey AS kept, merged FROM (SELECT *, row_number() OVER (PARTITION BY canonical, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n, count(*) OVER (PARTITION BY canonical, c_mktsegment) AS merged FROM (SELECT *, c_custkey % 100 AS canonical FROM {c})) WHERE n = 1",
    "SELECT c_custkey % 100 AS canonical, c_mktsegment AS name, c_custkey AS kept, count(*) OVER (PARTITION BY c_custkey % 100, c_mktsegment) AS merged FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 100, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1",
)
family.sql(
    "sk13_ghost_project_cleanup", {"o": lambda s, d: X.load(s, d, "orders"), "c": lambda s, d: X.load(s, d, "customer")},
    "SELECT c_custkey, path, count(o_orderkey) AS rows FROM (SELECT c_custkey, concat(CASE c_custkey % 7 WHEN 0 THEN '/tmp/' WHEN 1 THEN '/var/folders/' ELSE '/home/' END, cast(c_custkey AS string)) AS path FROM {c}) LEFT JOIN {o} ON o_custkey = c_custkey WHERE path LIKE '/tmp/%' OR path LIKE '/var/folders/%' GROUP BY c_custkey, path",
    "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '/tmp/' ELSE '/var/folders/' END || c_custkey AS path, count(o_orderkey) AS rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 < 2 GROUP BY c_custkey",
)
family.sql(
    "sk16_large_content_prune", {"f": X.files}, "SELECT path, CASE WHEN octet_length(content) <= 4000 THEN md5(content) END AS content FROM {f}",
    f"WITH {X.FILES} SELECT path, CASE WHEN octet_length(encode(content)) <= 4000 THEN md5(content) END AS content FROM files",
)
family.sql(
    "c3_chunking_outcome", {"c": X.chunks}, "SELECT path, CASE WHEN n = 1 AND total = 0 THEN 'empty' WHEN n > 10 THEN 'ast' ELSE 'fallback' END AS outcome, n > 10 OR total > 0 AS settled FROM (SELECT path, count(*) AS n, sum(length(code)) AS total FROM {c} GROUP BY path)",
    f"WITH {X.CHUNKS} SELECT path, CASE WHEN count(*) = 1 AND sum(length(code)) = 0 THEN 'empty' WHEN count(*) > 10 THEN 'ast' ELSE 'fallback' END AS outcome, count(*) > 10 OR sum(length(code)) > 0 AS settled FROM chunks GROUP BY path",
)
family.sql(
    "c4_embed_text", {"c": X.chunks}, "SELECT path, chunk_index, md5(concat('// Context: ', breadcrumb, '\n', code)) AS digest FROM {c}",
    f"WITH {X.CHUNKS} SELECT path, chunk_index, md5('// Context: ' || breadcrumb || chr(10) || code) AS digest FROM chunks",
)
family.sql(
    "x13_repair_candidates", {"c": X.chunks, "k": X.known_files}, "SELECT path, round(indexed / n, 6) AS coverage FROM (SELECT c.path, count(*) AS n, count_if(k.hash = c.hash AND c.chunk_index % 9 <> 0) AS indexed FROM {c} c LEFT JOIN {k} k ON k.path = c.path GROUP BY c.path) WHERE indexed / n < 0.95",
    f"WITH {X.CHUNKS}, {X.KNOWN}, r AS (SELECT c.path, count(*) AS n, count(*) FILTER (WHERE k.hash = c.hash AND c.chunk_index % 9 <> 0) AS indexed FROM chunks c LEFT JOIN known k ON k.path = c.path GROUP BY c.path) SELECT path, round(indexed / n, 6) AS coverage FROM r WHERE indexed / n < 0.95",
)
family.sql(
    "x19_stale_index_directories", {"f": X.files}, "SELECT project, sum(size) AS bytes FROM (SELECT split(path, '/')[1] AS project, size, doc_id % 40 = 0 AS db, doc_id % 3 = 0 AND doc_id % 2 = 1 AS snap FROM {f}) GROUP BY project HAVING bool_or(db) AND NOT bool_or(snap)",
    f"WITH {X.FILES} SELECT string_split(path, '/')[2] AS project, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1 HAVING bool_or(doc_id % 40 = 0) AND NOT bool_or(doc_id % 3 = 0 AND doc_id % 2 = 1)",
)
family.sql(
    "x20_repair_plan_dedupe", {"u": X.usage}, "SELECT DISTINCT project_id, concat('rebuild ', index_state) AS message FROM {u} WHERE k % 4 = 0",
    f"WITH {X.USAGE} SELECT DISTINCT project_id, 'rebuild ' || index_state AS message FROM usage WHERE k % 4 = 0",
)
_LINK = r'href="([^"]+)"'
family.sql(
    "g12_page_links", {"p": lambda s, d: X.load(s, d, "pages")}, f"SELECT page_id, target, count(*) AS n FROM (SELECT page_id, explode(regexp_extract_all(html, '{_LINK}', 1)) AS target FROM {{p}}) GROUP BY page_id, target",
    f"SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS target FROM pages) GROUP BY page_id, target",
)
