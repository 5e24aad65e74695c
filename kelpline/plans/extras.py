"""Queries of sinks, imports, contracts, feedback and finder ranks, synonyms, rate slots and queue steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import contracts, symbols
from kelpline.operators.fusion import top_k
from kelpline.operators.memory import CONFIRMED_WEIGHT, weight_of
from kelpline.plans.registry import Family
from kelpline.sources import crawl as C
from kelpline.sources import fixtures as X
from kelpline.sources.store import shared_path

family = Family()


@family.add("sc1_directory_crawl")
def sc1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.crawl(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "size")


_CASE = "SELECT item_id, concat('{{\"id\":\"c', cast(item_id AS string), '\",\"expected\":[\"a', cast(item_id % 3 AS string), '\",\"b\"],\"tags\":', CASE WHEN item_id % 2 = 0 THEN '[\"t\"]' ELSE 'null' END, CASE WHEN item_id % 9 = 8 THEN '' ELSE '}}' END) AS line FROM {b}"


@family.add("sc15_json_cases", "SELECT 'c' || item_id AS id, 'a' || (item_id % 3) || ',b' AS expected, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS n_tags FROM benchmark WHERE item_id % 9 <> 8")
def sc15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(_CASE, b=X.load(spark, sf_dir, "benchmark"))
    r = C.import_json(lines, "line", "id string, expected array<string>, tags array<string>", ["id", "expected"])
    return r.select("id", F.array_join("expected", ",").alias("expected"), F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags")).withColumn("n_tags", F.greatest("n_tags", F.lit(0)))


@family.add("x17_json_import", "SELECT 'c' || item_id AS id FROM benchmark WHERE item_id % 9 <> 8")
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports run only where the target is empty; bad documents are skipped."""
    target = spark.sql("SELECT cast(null AS string) AS id WHERE false")
    lines = spark.sql(_CASE, b=X.load(spark, sf_dir, "benchmark"))
    return C.import_json(lines, "line", "id string, expected array<string>", ["expected"]).select("id") if target.isEmpty() else target


@family.add("sk14_append_by_day", f"WITH {X.USAGE} SELECT day, count(*) AS n FROM usage WHERE k % 2 = 0 OR day >= '2024-01-10' GROUP BY day")
def sk14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a table partitioned by day."""
    path, u = shared_path(spark, "usage"), X.usage(spark, sf_dir).select("event_id", "k", "day")
    u.filter("k % 2 = 0").write.mode("append").partitionBy("day").parquet(path)
    u.filter("k % 2 = 1 AND day >= '2024-01-10'").write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


family.sql(
    "sk17_report_lines", {"u": X.usage}, "SELECT concat('- ', tool_name, ': ', cast(count(*) AS string), ' calls, ', cast(count_if(status = 'error') AS string), ' errors') AS line FROM {u} GROUP BY tool_name",
    f"WITH {X.USAGE} SELECT '- ' || tool_name || ': ' || count(*) || ' calls, ' || count(*) FILTER (WHERE status = 'error') || ' errors' AS line FROM usage GROUP BY tool_name",
)


@family.add(
    "r17_feedback_rank",
    f"""WITH {X.MEMORIES}, s AS (SELECT id, project_id, updated_at, CASE WHEN h > 0 THEN 6 + 2 * h ELSE 0 END + CASE WHEN fact_key IN ('fact-1', 'fact-4') THEN 14 ELSE 0 END + CASE WHEN id LIKE '%:3' THEN 8 ELSE 0 END + CASE WHEN type IN ('feedback', 'fact') THEN 4 ELSE 0 END AS score
FROM (SELECT *, len(list_filter(['the', 'user', 'of'], lambda t: contains(lower(title || ' ' || summary || ' ' || array_to_string(tags, ' ')), t))) AS h FROM memories)) SELECT project_id, id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, updated_at DESC, id) <= 3""",
)
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback by query terms, by the modules it is about, by the same query, and by its being negative."""
    hay = F.lower(F.concat_ws(" ", "title", "summary", F.array_join("tags", " ")))
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in ("the", "user", "of")]), lambda t: F.contains(hay, t)))
    score = F.when(hits > 0, 6 + 2 * hits).otherwise(0) + F.when(F.col("fact_key").isin("fact-1", "fact-4"), 14).otherwise(0) + F.when(F.col("id").endswith(":3"), 8).otherwise(0) + F.when(F.col("type").isin("feedback", "fact"), 4).otherwise(0)
    m = X.memories(spark, sf_dir).withColumn("score", score).filter("score > 0")
    return top_k(m, ["project_id"], [F.col("score").desc(), F.col("updated_at").desc(), "id"], 3).select("project_id", "id", "score")


@family.add(
    "r19_memory_finder",
    f"WITH {X.FEATURES}, s AS (SELECT feature_id, CASE WHEN contains(lower(name), 'small') THEN 20 ELSE 0 END + CASE WHEN contains(lower(responsibility), 'small') THEN 10 ELSE 0 END + 3 * len(list_filter(exports, lambda e: contains(lower(e), 'small'))) + CASE confirmation_status WHEN 'human-confirmed' THEN 6 ELSE 2 END AS score FROM features WHERE confirmation_status <> 'suggested') SELECT feature_id, CAST(score AS INTEGER) AS score FROM s WHERE score > 6",
)
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, q = X.features(spark, sf_dir).filter("confirmation_status <> 'suggested'"), F.lit("small")

    def hit(c, w):
        return F.when(F.contains(F.lower(c), q), w).otherwise(0)

    score = hit(F.col("name"), 20) + hit(F.col("responsibility"), 10) + 3 * F.size(F.filter("exports", lambda e: F.contains(F.lower(e), q))) + weight_of(F.col("confirmation_status"), CONFIRMED_WEIGHT, 4)
    return f.select("feature_id", score.cast("int").alias("score")).filter("score > 6")


# Synonyms of overview terms, with weights.
_SYNONYMS = "VALUES ('src1', 'alpha', 1.0D), ('src2', 'alpha', 0.6D), ('en', 'alpha', 0.4D), ('fr', 'beta', 1.0D), ('src1', 'beta', 0.5D)"


@family.add(
    "r27_synonym_path_relevance",
    f"WITH {X.FILES}, y AS (SELECT * FROM ({_SYNONYMS.replace('0D', '0').replace('6D', '6').replace('4D', '4').replace('5D', '5')}) t(token, term, weight)), p AS (SELECT path, unnest(list_distinct(regexp_split_to_array(path, '[/.]'))) AS token FROM files), m AS (SELECT path, term, max(weight) AS w FROM p JOIN y ON y.token = p.token GROUP BY ALL) SELECT path, round(sum(w)::DOUBLE, 6) AS relevance FROM m GROUP BY path",
)
def r27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path's relevance: for every query term the best weight of its tokens' synonyms, summed."""
    y = spark.sql(f"SELECT * FROM {_SYNONYMS} AS t(token, term, weight)")
    p = X.files(spark, sf_dir).select("path", F.explode(F.array_distinct(F.split("path", "[/.]"))).alias("token"))
    return p.join(y, "token").groupBy("path", "term").agg(F.max("weight").alias("w")).groupBy("path").agg(F.round(F.sum("w"), 6).alias("relevance"))


_NAMES = "SELECT doc_id, concat('app/', CASE doc_id % 5 WHEN 0 THEN concat('app/api/v', cast(doc_id AS string), '/route.ts') WHEN 1 THEN concat('pages/api/u', cast(doc_id AS string), '/index.tsx') WHEN 2 THEN 'x/index.ts' WHEN 3 THEN 'y/__init__.py' ELSE concat('z', cast(doc_id AS string), '.ts') END) AS path, concat('return Response.json({{ id: ', cast(doc_id AS string), ', name', cast(doc_id % 3 AS string), ' : x }})') AS content FROM {d}"


@family.add("g14_route_and_response_keys", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/api/v' || doc_id WHEN 1 THEN '/api/u' || doc_id END AS route, 'id,name' || (doc_id % 3) AS keys FROM documents")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.sql(_NAMES, d=X.load(spark, sf_dir, "documents"))
    return n.select("doc_id", contracts.route_of(F.col("path")).alias("route"), F.array_join(contracts.response_keys(F.col("content")), ",").alias("keys"))


@family.add("pf9_barrel_files", "SELECT doc_id, doc_id % 5 IN (2, 3) OR doc_id % 5 = 1 AS barrel FROM documents")
def pf9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NAMES, d=X.load(spark, sf_dir, "documents")).select("doc_id", contracts.barrel(F.col("path")).alias("barrel"))


_SLOT = "SELECT event_id, project_id, wait FROM (SELECT event_id, project_id, greatest(0, coalesce(max(t - 40 * n) OVER (PARTITION BY project_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 40 * n, 0) - t) AS wait FROM (SELECT event_id, project_id, {ms} AS t, row_number() OVER (PARTITION BY project_id ORDER BY event_id) AS n FROM {u}))"
family.sql(
    "st7_rate_slots", {"u": X.usage}, _SLOT.replace("{ms}", "event_id * 7"),
    f"WITH {X.USAGE} " + _SLOT.replace("{ms}", "event_id * 7").replace("{u}", "usage"),
)
family.sql(
    "st1_queue_step", {"t": X.tasks}, "SELECT task_id, CASE WHEN status = 'running' THEN 'done' WHEN status = 'queued' AND n = 1 AND busy = 0 THEN 'running' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY project_id, status ORDER BY priority DESC, created_at, task_id) AS n, count_if(status = 'running') OVER (PARTITION BY project_id) AS busy FROM {t})",
    f"WITH {X.TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, status ORDER BY priority DESC, created_at, task_id) AS n, count(*) FILTER (WHERE status = 'running') OVER (PARTITION BY project_id) AS busy FROM tasks) SELECT task_id, CASE WHEN status = 'running' THEN 'done' WHEN status = 'queued' AND n = 1 AND busy = 0 THEN 'running' ELSE status END AS status FROM r",
)
_PYTHON = "SELECT path, concat('import os\nx = 1\n', repeat(concat('def f', cast(doc_id AS string), '(a):\n    return a + ', cast(size AS string), '\n'), cast(doc_id % 40 AS int))) AS content FROM {f}"


@family.add("c2_python_chunker")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole statements of generated Python sources in chunks that cover each source."""
    return symbols.chunk_python(spark.sql(_PYTHON, f=X.files(spark, sf_dir)), 200)


@family.add("f_identifier_variants", "SELECT DISTINCT 'getUser' || c_nationkey AS name, 'getuser' || c_nationkey AS lower, 'get_user' || c_nationkey AS snake FROM customer")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.load(spark, sf_dir, "customer").select(F.concat(F.lit("getUser"), F.col("c_nationkey").cast("string")).alias("name")).distinct()
    v = T.identifier_variants(F.col("name"))
    return n.select("name", F.element_at(v, 1).alias("lower"), F.element_at(v, 2).alias("snake"))
