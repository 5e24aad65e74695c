"""Views over the driver's tables in the shapes that the operators take, with the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2025-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return d.select("doc_id", path.alias("path"), F.md5("text").alias("hash"), F.octet_length("text").cast("long").alias("size"), F.col("lang").alias("language"), F.col("text").alias("content"))


FILES = "files AS (SELECT doc_id, 'src/' || source || '/' || doc_id || '.' || lang AS path, md5(text) AS hash, CAST(octet_length(encode(text)) AS BIGINT) AS size, lang AS language, text AS content FROM documents)"


def lines(f: DataFrame) -> DataFrame:
    """A row for each line of `files`, with the file's columns."""
    return f.select("*", F.posexplode(F.split("content", "\n")).alias("chunk_index", "code"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lines(files(spark, sf_dir)).select("path", "hash", "language", "chunk_index", "code")
    return c.withColumn("breadcrumb", F.concat("path", F.lit(" > p"), F.col("chunk_index").cast("string")))


CHUNKS = FILES + ", lines AS (SELECT path, hash, language, string_split(content, chr(10)) AS l FROM files), chunks AS (SELECT path, hash, language, CAST(i AS INTEGER) AS chunk_index, l[i + 1] AS code, path || ' > p' || i AS breadcrumb FROM lines, unnest(range(len(l))) AS t(i))"


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older index of `files`: some paths missing, some hashes old, some gone from disk."""
    f = files(spark, sf_dir).filter(F.col("doc_id") % 10 != 3)
    old = F.when(F.col("doc_id") % 10 == 7, F.md5(F.col("hash"))).otherwise(F.col("hash"))
    mark = F.when(F.col("doc_id") % 10 == 5, None).when(F.col("doc_id") % 10 == 6, F.lit("stale")).otherwise(old)
    gone = f.filter(F.col("doc_id") % 10 == 1).select("doc_id", F.concat("path", F.lit(".old")).alias("path"), "hash", "size", "language", F.col("hash").alias("vector_index_hash"))
    return f.select("doc_id", "path", old.alias("hash"), "size", "language", mark.alias("vector_index_hash")).union(gone)


KNOWN = """known AS (SELECT doc_id, path, CASE WHEN doc_id % 10 = 7 THEN md5(hash) ELSE hash END AS hash, size, language,
  CASE WHEN doc_id % 10 = 5 THEN NULL WHEN doc_id % 10 = 6 THEN 'stale' WHEN doc_id % 10 = 7 THEN md5(hash) ELSE hash END AS vector_index_hash FROM files WHERE doc_id % 10 <> 3
  UNION ALL SELECT doc_id, path || '.old', hash, size, language, hash FROM files WHERE doc_id % 10 = 1)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool calls: project, tool, status, duration, state of the index, day."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.element_at(F.array(F.lit("ready"), F.lit("missing"), F.lit("stale")), k % 3 + 1)
    return e.select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").cast("string").alias("project_id"), F.col("event_type").alias("tool_name"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("value").alias("duration_ms"), state.alias("index_state"), k.alias("k"),
    )


USAGE = """usage AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS project_id, event_type AS tool_name,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value AS duration_ms,
  (['ready', 'missing', 'stale'])[CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 + 1] AS index_state, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("project_id"), status.alias("status"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("created_at"), F.when(F.col("o_totalprice") > 100000, "full").otherwise("incremental").alias("scope"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
  6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_at, CASE WHEN o_totalprice > 100000 THEN 'full' ELSE 'incremental' END AS scope FROM orders)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order -> part -> supplier -> nation -> region, as typed edges. Each type is made distinct by its keys, as the ids are three times as long."""
    li, su, na = (load(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))

    def edge(df: DataFrame, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        return df.select(ka, kb).distinct().select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("from_id"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("to_id"), F.lit(kind).alias("type"))

    # Nearly every row is an edge of its own. A number given for its shuffle holds: by size Spark would put so many of these
    # short rows, which compress well, into one task that its memory grows with the table.
    calls = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey", "l_partkey")
    out = edge(calls, "o", "l_orderkey", "p", "l_partkey", "CALLS").union(edge(li, "p", "l_partkey", "s", "l_suppkey", "IMPORTS"))
    return out.union(edge(su, "s", "s_suppkey", "n", "s_nationkey", "EXTENDS")).union(edge(na, "n", "n_nationkey", "r", "n_regionkey", "HAS_METHOD"))


EDGES = """edges AS (SELECT 'o' || l_orderkey AS from_id, 'p' || l_partkey AS to_id, 'CALLS' AS type FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey, 'IMPORTS' FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey, 'EXTENDS' FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'HAS_METHOD' FROM nation)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of `edges` as symbols; parts and suppliers have paths and line ranges."""
    p, s, n, r = (load(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))

    def node(df: DataFrame, prefix: str, k: str, name: str, kind: str, folder: str) -> DataFrame:
        key = F.col(k).cast("string")
        return df.select(
            F.concat(F.lit(prefix), key).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), F.concat(F.lit(folder), (F.col(k) % 50).cast("string"), F.lit(".ts")).alias("file_path"),
            (F.col(k) % 200 + 1).cast("int").alias("start_line"), (F.col(k) % 200 + 1 + F.col(k) % 17).cast("int").alias("end_line"), (F.col(k) % 3 == 0).alias("exported"), F.lit("ts").alias("language"),
        )

    out = node(p, "p", "p_partkey", "p_name", "Function", "src/api/").union(node(s, "s", "s_suppkey", "s_name", "Class", "src/lib/"))
    return out.union(node(n, "n", "n_nationkey", "n_name", "Module", "src/core/")).union(node(r, "r", "r_regionkey", "r_name", "Module", "src/"))


def _symbol_sql(table: str, prefix: str, k: str, name: str, kind: str, folder: str) -> str:
    return f"SELECT '{prefix}' || {k} AS id, {name} AS name, '{kind}' AS type, '{folder}' || ({k} % 50) || '.ts' AS file_path, CAST({k} % 200 + 1 AS INTEGER) AS start_line, CAST({k} % 200 + 1 + {k} % 17 AS INTEGER) AS end_line, {k} % 3 = 0 AS exported, 'ts' AS language FROM {table}"


SYMBOLS = "symbols AS (" + " UNION ALL ".join([_symbol_sql("part", "p", "p_partkey", "p_name", "Function", "src/api/"), _symbol_sql("supplier", "s", "s_suppkey", "s_name", "Class", "src/lib/"), _symbol_sql("nation", "n", "n_nationkey", "n_name", "Module", "src/core/"), _symbol_sql("region", "r", "r_regionkey", "r_name", "Module", "src/")]) + ")"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as long-term memories; dates and tags are derived from the keys."""
    c = load(spark, sf_dir, "conversations")
    kinds = F.array(*[F.lit(x) for x in ("reference", "project-state", "feedback", "preference", "decision", "fact", "journal")])
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") * 7 % 360).cast("int"))
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project_id"),
        F.element_at(kinds, (F.col("conv_id") % 7 + 1).cast("int")).alias("type"), F.when(F.col("turn") % 2 == 0, "project").otherwise("global-user").alias("scope"),
        F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("summary"), F.when(F.col("role") == "user", "user-explicit").otherwise("agent-inferred").alias("source"),
        (F.lit(1.0) / (F.col("turn") + 1)).alias("confidence"), F.array(F.col("role"), F.concat(F.lit("t"), (F.col("turn") % 4).cast("string"))).alias("tags"),
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("fact-"), (F.col("conv_id") % 9).cast("string"))).alias("fact_key"), day.alias("updated_at"),
        F.when(F.col("conv_id") % 6 == 0, F.date_add(day, 90)).alias("valid_until"), F.when(F.col("conv_id") % 11 == 0, F.lit("superseded-by:x")).alias("provenance"),
    )


MEMORIES = """memories AS (SELECT conv_id || ':' || turn AS id, 'p' || (conv_id % 5) AS project_id,
  (['reference', 'project-state', 'feedback', 'preference', 'decision', 'fact', 'journal'])[conv_id % 7 + 1] AS type, CASE WHEN turn % 2 = 0 THEN 'project' ELSE 'global-user' END AS scope,
  split_part(text, '.', 1) AS title, text AS summary, CASE WHEN role = 'user' THEN 'user-explicit' ELSE 'agent-inferred' END AS source, 1.0::DOUBLE / (turn + 1) AS confidence,
  [role, 't' || (turn % 4)] AS tags, CASE WHEN conv_id % 4 = 0 THEN 'fact-' || (conv_id % 9) END AS fact_key, CAST(DATE '2024-01-01' + CAST(conv_id * 7 % 360 AS INTEGER) AS DATE) AS updated_at,
  CASE WHEN conv_id % 6 = 0 THEN CAST(DATE '2024-01-01' + CAST(conv_id * 7 % 360 AS INTEGER) + 90 AS DATE) END AS valid_until, CASE WHEN conv_id % 11 = 0 THEN 'superseded-by:x' END AS provenance FROM conversations)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as feature memories of suppliers' modules."""
    p = load(spark, sf_dir, "part")
    status = F.when(F.col("p_size") % 10 == 0, "suggested").when(F.col("p_size") % 3 == 0, "agent-inferred").otherwise("human-confirmed")
    return p.select(
        F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 13 == 0, "").otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("responsibility"),
        F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("dir"), F.array(F.concat(F.lit("f"), (F.col("p_partkey") % 40).cast("string"), F.lit(".ts"))).alias("files"),
        F.split("p_type", " ").alias("exports"), status.alias("confirmation_status"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("updated_at"),
    )


FEATURES = """features AS (SELECT p_partkey AS feature_id, p_name AS name, CASE WHEN p_size % 13 = 0 THEN '' ELSE p_brand || ' ' || p_type END AS responsibility,
  'src/' || lower(replace(p_brand, '#', '')) AS dir, ['f' || (p_partkey % 40) || '.ts'] AS files, string_split(p_type, ' ') AS exports,
  CASE WHEN p_size % 10 = 0 THEN 'suggested' WHEN p_size % 3 = 0 THEN 'agent-inferred' ELSE 'human-confirmed' END AS confirmation_status,
  CAST(DATE '2024-01-01' + CAST(p_partkey % 365 AS INTEGER) AS DATE) AS updated_at FROM part)"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as classes, four to a file, each with four methods and two properties below it."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 2 == 0).alias("exported"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    return s.selectExpr(
        "concat('c', k, CASE WHEN j = 0 THEN '' ELSE concat('.', j) END) AS id", "CASE WHEN j = 0 THEN concat('C', k % 8) WHEN j < 5 THEN concat('m', k * j % 3) ELSE concat('p', j % 2) END AS name",
        "CASE WHEN j = 0 THEN 'Class' WHEN j < 5 THEN 'Method' ELSE 'Variable' END AS type", "concat('src/lib/', k div 4, '.ts') AS file_path", "'typescript' AS language", "exported",
        "CASE WHEN j > 0 THEN concat('c', k) END AS parent_id", "cast(k % 4 * 100 + j * 10 AS int) AS start_line", "CASE WHEN j BETWEEN 1 AND 4 AND (k + j) % 3 > 0 THEN concat('R', j) END AS returns",
    )


CLASSES = """classes AS (SELECT 'c' || k || CASE WHEN j = 0 THEN '' ELSE '.' || j END AS id, CASE WHEN j = 0 THEN 'C' || (k % 8) WHEN j < 5 THEN 'm' || (k * j % 3) ELSE 'p' || (j % 2) END AS name,
  CASE WHEN j = 0 THEN 'Class' WHEN j < 5 THEN 'Method' ELSE 'Variable' END AS type, 'src/lib/' || (k // 4) || '.ts' AS file_path, 'typescript' AS language, exported,
  CASE WHEN j > 0 THEN 'c' || k END AS parent_id, CAST(k % 4 * 100 + j * 10 AS INTEGER) AS start_line, CASE WHEN j BETWEEN 1 AND 4 AND (k + j) % 3 > 0 THEN 'R' || j END AS returns
  FROM (SELECT s_suppkey AS k, s_nationkey % 2 = 0 AS exported, unnest(range(0, 7)) AS j FROM supplier))"""
