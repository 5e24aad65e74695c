"""Queries of intents, import and route resolution, recall variants, sets, text functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions import intent as N
from kelpline.functions import text as T
from kelpline.operators import contracts, diversity, fusion, snippet, symbols
from kelpline.operators import imports as R
from kelpline.plans import retrieval as Q
from kelpline.plans.registry import Family
from kelpline.sources import fixtures as X
from kelpline.sources.store import shared_path
from kelpline.streaming import events as E

family = Family()
FILES = {"f": X.files}

# Queries made from items: a path, a code name, an architecture word, a concept word or none in front.
_Q = "SELECT item_id, concat(element_at(array('./a/b.ts ', 'getUser ', 'the service layer ', 'how ', ''), cast(item_id % 5 + 1 AS int)), lower(regexp_replace(text, '[^a-zA-Z ]', ''))) AS query, CASE WHEN item_id % 7 = 0 THEN array('x') ELSE cast(array() AS array<string>) END AS terms FROM {b}"
_INTENT_SQL = """q AS (SELECT item_id, string_split_regex(trim((['./a/b.ts ', 'getUser ', 'the service layer ', 'how ', ''])[item_id % 5 + 1] || lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g'))), '\\s+') AS w, item_id % 7 = 0 AS terms FROM benchmark),
n AS (SELECT item_id, terms, len(w) AS n, len(list_filter(w, lambda x: x LIKE './%')) AS path, len(list_filter(w, lambda x: regexp_matches(x, 'architecture|boundary|entrypoint|startup|adapter|adaptation|handler|service|workflow|coupling|coupled|mode|layer') AND NOT regexp_matches(x, '[A-Z_.]'))) AS arch,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Z_.]'))) AS code, len(list_filter(w, lambda x: regexp_matches(lower(x), 'how|why|what|flow|architecture|concept'))) AS concept FROM q),
intents AS (SELECT item_id, CASE WHEN path >= 1 THEN 'navigation' WHEN terms AND NOT (arch >= 2 OR (arch >= 1 AND n >= 8)) THEN 'symbol_lookup' WHEN arch >= 1 THEN 'architecture' WHEN n <= 6 AND code >= 1 THEN 'symbol_lookup' WHEN concept >= 1 THEN 'conceptual' ELSE 'balanced' END AS intent FROM n)"""


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.sql(_Q, b=X.load(spark, sf_dir, "benchmark"))
    return q.select("item_id", N.intent(F.col("query"), F.col("terms")).alias("intent"))


@family.add("pf6_query_intent", f"WITH {_INTENT_SQL} SELECT * FROM intents")
def pf6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents(spark, sf_dir)


@family.add(
    "pf7_intent_settings",
    f"WITH {_INTENT_SQL}, s AS (SELECT * FROM (VALUES ('symbol_lookup', 0.35, 8, 16), ('navigation', 0.3, 6, 12), ('architecture', 0.25, 8, 16), ('conceptual', 0.55, 10, 24), ('balanced', 0.6, 10, 24)) t(intent, w_vec, rerank_top_n, rerank_max_pool)) SELECT i.item_id, i.intent, w_vec::DOUBLE AS w_vec, rerank_top_n, rerank_max_pool FROM intents i JOIN s ON s.intent = i.intent",
)
def pf7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents(spark, sf_dir).join(N.settings(spark), "intent").select("item_id", "intent", "w_vec", "rerank_top_n", "rerank_max_pool")


@family.add("r15_query_split", "SELECT item_id, text AS semantic, CASE WHEN item_id % 3 = 0 THEN 'T' || item_id ELSE text END AS lexical, trim(text || ' ' || CASE WHEN item_id % 3 = 0 THEN 'T' || item_id ELSE '' END) AS combined FROM benchmark")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("T"), F.col("item_id").cast("string"))).otherwise("")
    b = X.load(spark, sf_dir, "benchmark").withColumn("term", term)
    return b.select("item_id", F.col("text").alias("semantic"), F.coalesce(F.nullif("term", F.lit("")), "text").alias("lexical"), F.trim(F.concat_ws(" ", "text", "term")).alias("combined"))


# Imports between files of the tree src/<source>/<id>.ts, as relative names.
_FILES = "SELECT doc_id, concat('src/', source, '/', CASE WHEN doc_id % 5 = 0 THEN concat('m', cast(doc_id AS string), '/index.ts') WHEN doc_id % 5 = 1 THEN concat('f', cast(doc_id AS string), '.tsx') ELSE concat('f', cast(doc_id AS string), '.ts') END) AS path FROM {d}"
_IMPORTS = "SELECT doc_id AS import_id, 'typescript' AS language, concat('src/', source) AS folder, concat('../', source, '/./', CASE WHEN doc_id % 5 = 0 THEN 'm' ELSE 'f' END, cast(doc_id AS string), CASE WHEN doc_id % 5 = 2 THEN '.js' WHEN doc_id % 5 = 4 THEN 'x' ELSE '' END) AS name FROM {d}"


@family.add(
    "j14_import_resolution",
    "SELECT doc_id AS import_id, 'src/' || source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'm' || doc_id || '/index.ts' WHEN doc_id % 5 = 1 THEN 'f' || doc_id || '.tsx' ELSE 'f' || doc_id || '.ts' END AS target FROM documents WHERE doc_id % 5 <> 4",
)
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.load(spark, sf_dir, "documents")
    return R.resolve(spark.sql(_IMPORTS, d=d), spark.sql(_FILES, d=d))


_PY = "SELECT doc_id AS import_id, 'python' AS language, concat('app/', source, '/x') AS folder, concat('pkg.m', cast(doc_id % 60 AS string)) AS name FROM {d}"
_PYFILES = "SELECT DISTINCT concat('app/', source, '/pkg/m', cast(doc_id % 60 AS string), '.py') AS path FROM {d}"


@family.add(
    "j14_suffix_import_resolution",
    "WITH f AS (SELECT DISTINCT 'app/' || source || '/pkg/m' || (doc_id % 60) || '.py' AS path, source, doc_id % 60 AS m FROM documents) SELECT d.doc_id AS import_id, f.path AS target FROM documents d JOIN f ON f.m = d.doc_id % 60 QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY CASE WHEN f.source = d.source THEN 0 ELSE 1 END, length(f.path), f.path) = 1",
)
def j14b(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.load(spark, sf_dir, "documents")
    return R.resolve(spark.sql(_PY, d=d), spark.sql(_PYFILES, d=d))


_CALLS = "SELECT path, concat('const a = fetch(\"/api/', cast(doc_id % 30 AS string), '\"); ', CASE WHEN doc_id % 4 = 0 THEN 'fetch(\\'/api/7\\')' ELSE '' END) AS content FROM {f}"


@family.add(
    "j17_route_consumers",
    f"WITH {X.FILES}, c AS (SELECT path, '/api/' || (doc_id % 30) AS route FROM files UNION SELECT path, '/api/7' FROM files WHERE doc_id % 4 = 0), r AS (SELECT '/api/' || doc_id AS route, path AS file_path FROM files) SELECT r.route, c.path AS consumer FROM r JOIN c ON c.route = r.route AND c.path <> r.file_path",
)
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.files(spark, sf_dir)
    routes = f.select(F.concat(F.lit("/api/"), F.col("doc_id").cast("string")).alias("route"), F.col("path").alias("file_path"))
    return contracts.consumers(routes, spark.sql(_CALLS, f=f))


family.sql(
    "a27_contract_mismatch", {"f": X.features}, "SELECT feature_id, array_join(array_sort(array_except(exports, array('PROMO', 'SMALL'))), ',') AS missing, size(array_except(array('PROMO', 'SMALL'), exports)) AS unused FROM {f}",
    f"WITH {X.FEATURES} SELECT feature_id, array_to_string(list_sort(list_distinct(list_filter(exports, lambda e: NOT list_contains(['PROMO', 'SMALL'], e)))), ',') AS missing, len(list_filter(['PROMO', 'SMALL'], lambda e: NOT list_contains(exports, e))) AS unused FROM features",
)
family.sql(
    "a26_parity_counters", {"u": X.usage}, "SELECT coalesce(tool_name, 'all') AS track, coalesce(index_state, 'all') AS status, count(*) AS n FROM {u} GROUP BY GROUPING SETS ((tool_name), (index_state), (tool_name, index_state), ())",
    f"WITH {X.USAGE} SELECT coalesce(tool_name, 'all') AS track, coalesce(index_state, 'all') AS status, count(*) AS n FROM usage GROUP BY GROUPING SETS ((tool_name), (index_state), (tool_name, index_state), ())",
)

# Recall variants.


_R5_SQL = f"""WITH {Q.CHUNK_HITS.replace("tp_", "cp_").replace("scored", "c_scored").replace("picked", "c_picked").replace("ranked", "c_ranked").replace("qt AS", "c_qt AS").replace("JOIN qt", "JOIN c_qt").replace("toks", "c_toks").replace("stats", "c_stats").replace("post AS", "c_post AS").replace("FROM post", "FROM c_post").replace("dfs", "c_dfs")},
{Q.FILE_HITS.removeprefix(X.FILES + ", ")}
SELECT query_id, path, score, 'chunks' AS strategy FROM c_ranked UNION ALL SELECT query_id, path, score, 'files' FROM ranked WHERE query_id NOT IN (SELECT query_id FROM c_ranked)"""


@family.add("r5_lexical_fallback", _R5_SQL)
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk hits of each query that has any, else its file hits."""
    files = Q.file_hits(spark, sf_dir).select("query_id", "path", "score", F.lit("files").alias("strategy"))
    return fusion.fallback(Q.r3(spark, sf_dir).select("query_id", "path", "score", F.lit("chunks").alias("strategy")), files)


@family.add("r11_rank_reranker", f"WITH {Q.FILE_HITS} SELECT query_id, path, CASE WHEN rank % 5 = 4 THEN 0.0::DOUBLE ELSE round(1 - rank / count(*) OVER (PARTITION BY query_id), 6) END AS score FROM ranked")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listwise reranker's order as scores: 1 - rank / n, 0 for what it left out."""
    h = Q.file_hits(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return h.select("query_id", "path", F.when(F.col("rank") % 5 == 4, 0.0).otherwise(F.round(1 - F.col("rank") / F.col("n"), 6)).alias("score"))


@family.add("r12_rerank_text", f"WITH {X.CHUNKS} SELECT path, chunk_index, CASE WHEN length(code) <= 100 THEN code ELSE substr(code, 1, 49) || '...' || right(code, 48) END AS middle, CASE WHEN length(code) <= 200 THEN code ELSE substr(code, 1, 134) || chr(10) || '...' || chr(10) || right(code, 61) END AS ends FROM chunks")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.chunks(spark, sf_dir)
    return c.select("path", "chunk_index", T.truncate_middle(F.col("code"), 100).alias("middle"), T.truncate_head_tail(F.col("code"), 200, 0.67).alias("ends"))


#: Takes lines step by step, above and below in turn, where the operator reckons how far both sides go.
_WINDOW = rf"""h AS (SELECT query_id, r.path, content AS code, 400 - length(r.path) - 1 AS room FROM ranked r JOIN files USING (path)), g AS (SELECT h.*, string_split(code, chr(10)) AS l FROM h),
sc AS (SELECT query_id, path, i AS n, len(list_filter(terms, lambda w: contains(lower(l[i]), w))) AS score FROM g JOIN terms USING (query_id), unnest(range(1, len(l) + 1)) t(i) WHERE length(code) > room),
hit AS (SELECT query_id, path, arg_min(n, n) FILTER (WHERE score = most) AS n FROM (SELECT *, max(score) OVER (PARTITION BY query_id, path) AS most FROM sc) WHERE most > 0 GROUP BY ALL),
w(query_id, path, lo, hi, used, side, stuck) AS (SELECT query_id, path, n, n, length(l[n]), 0, 0 FROM hit JOIN g USING (query_id, path)
  UNION ALL SELECT w.query_id, w.path, CASE WHEN side = 0 AND fit THEN lo - 1 ELSE lo END, CASE WHEN side = 1 AND fit THEN hi + 1 ELSE hi END, CASE WHEN fit THEN used + more ELSE used END, 1 - side, CASE WHEN fit THEN 0 ELSE stuck + 1 END
  FROM (SELECT w.*, length(g.l[CASE side WHEN 0 THEN lo - 1 ELSE hi + 1 END]) + 1 AS more, CASE side WHEN 0 THEN lo > 1 ELSE hi < len(g.l) END AND used + length(g.l[CASE side WHEN 0 THEN lo - 1 ELSE hi + 1 END]) + 1 <= room AS fit FROM w JOIN g USING (query_id, path) WHERE stuck < 2) w),
z AS (SELECT query_id, path, min(lo) AS lo, max(hi) AS hi FROM w GROUP BY ALL)
SELECT query_id, path, path || chr(10) || CASE WHEN length(code) <= room THEN code WHEN lo IS NULL THEN substr(code, 1, CAST(floor(room * 0.67) AS INTEGER)) || '...' || right(code, CAST(room - floor(room * 0.67) - 3 AS INTEGER))
  ELSE CASE WHEN lo > 1 THEN '...' ELSE '' END || array_to_string(l[lo:hi], chr(10)) || CASE WHEN hi < len(l) THEN '...' ELSE '' END END AS text FROM g LEFT JOIN z USING (query_id, path)"""


@family.add("r12_rerank_window", f"WITH RECURSIVE {Q.FILE_HITS}, {Q.TERMS}, {_WINDOW}")
def r12b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reranker reads of every file hit: the path and the lines around the best one."""
    f = X.files(spark, sf_dir).select("path", F.col("path").alias("breadcrumb"), F.col("content").alias("code"))
    return snippet.rerank_text(Q.file_hits(spark, sf_dir).select("query_id", "path").join(f, "path"), ["path"], X.queries(spark, sf_dir), 250, 400)


@family.add(
    "r14_cold_start_scan",
    rf"""WITH {X.FILES}, {Q.TERMS}, u AS (SELECT query_id, list_sort(terms) AS l FROM terms), t AS (SELECT query_id, i AS n, l[i] AS term, false AS technical FROM u, unnest(range(1, len(l) + 1)) r(i) UNION ALL SELECT item_id, 0, '/' || item_id, true FROM benchmark),
h AS (SELECT t.*, f.path, contains(lower(f.path), term) AS ip, instr(lower(f.content), term) AS place FROM t JOIN files f ON f.size <= 262144 AND (contains(lower(f.path), term) OR contains(lower(f.content), term))),
g AS (SELECT query_id, path, CAST(sum(CASE WHEN ip THEN CASE WHEN technical THEN 10 ELSE 3 END ELSE 0 END + CASE WHEN place > 0 THEN CASE WHEN technical THEN 20 ELSE 5 END ELSE 0 END) AS BIGINT) AS score, arg_min(ip, n) AS lead, arg_min(term, n) AS first_term, min(place) FILTER (WHERE place > 0) AS place, arg_min(term, place * 100000 + n) FILTER (WHERE place > 0) AS near FROM h GROUP BY query_id, path),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) - 1 AS rank FROM g QUALIFY rank < 5),
c AS (SELECT b.*, string_split(f.content, chr(10)) AS lines, len(string_split(left(f.content, CASE WHEN lead THEN 0 ELSE place - 1 END), chr(10))) AS line FROM b JOIN files f ON f.path = b.path)
SELECT query_id, path, rank, score, CASE WHEN lead THEN first_term ELSE near END AS token, greatest(line - 3, 1) AS start_line, least(line + 4, len(lines)) AS end_line, array_to_string(lines[greatest(line - 3, 1):least(line + 4, len(lines))], chr(10)) AS text FROM c""",
)
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the terms of each query, without an index, with a snippet; '/' and the item's number is its technical term."""
    q = X.queries(spark, sf_dir)
    words = q.select("query_id", F.posexplode(F.array_sort(F.array_distinct(T.tokens(F.col("query"))))).alias("n", "term"), F.lit(False).alias("technical"))
    named = q.select("query_id", F.lit(-1), F.concat(F.lit("/"), F.col("query_id").cast("string")), F.lit(True))
    return snippet.cold_start(X.files(spark, sf_dir), words.union(named))


@family.add(
    "r10_intent_short_circuit",
    f"WITH {Q.FUSED}, {_INTENT_SQL} SELECT f.query_id, f.key, f.score, i.intent FROM fused f JOIN intents i ON i.item_id = f.query_id WHERE i.intent <> 'symbol_lookup' OR f.source = 'lexical'",
)
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol lookup keeps its lexical list alone; other intents are fused."""
    f = Q.fused(spark, sf_dir).join(intents(spark, sf_dir).withColumnRenamed("item_id", "query_id"), "query_id")
    return f.filter("intent <> 'symbol_lookup' OR source = 'lexical'").select("query_id", "key", "score", "intent")


# Chunk rankings in which every third document lies outside src/, and their queries' words.
_OUT = "regexp_replace(file_path, '^src/(.*[0369][.])', '{}')"
_SPREAD_SQL = f"""WITH {Q.SCALED}, {Q.TERMS}, ranks AS (SELECT query_id, {_OUT.format(r"lib/\1")} AS file_path, chunk_index, score, position FROM scaled), tops AS (SELECT * FROM ranks WHERE position < 3),
words AS (SELECT query_id, list_filter(terms, lambda t: length(t) >= 3) AS words FROM terms)"""
_SHARED_SQL = r"len(list_filter(words, lambda w: len(list_filter(string_split_regex(lower(regexp_replace(file_path, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda p: p <> '' AND (contains(p, w) OR contains(w, p)))) > 0))"


def _spread(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ranks = Q.scaled(spark, sf_dir).withColumn("file_path", F.expr(_OUT.format("lib/$1")))
    words = X.queries(spark, sf_dir).select("query_id", F.array_distinct(T.tokens(F.col("query"))).alias("words"))
    return ranks, ranks.filter("position < 3"), words


@family.add(
    "w10_exploration_candidates",
    _SPREAD_SQL
    + f""", kinds(kind, mod, weight, priority) AS (VALUES ('import', 0, 3, 'high'), ('breadcrumb', 1, 2, 'medium'), ('neighbor', 2, 1, 'low')),
x AS (SELECT r.*, k.kind AS source, k.weight, k.priority, {_SHARED_SQL} AS overlap FROM ranks r JOIN kinds k ON k.mod = r.position % 3 JOIN words w ON w.query_id = r.query_id WHERE NOT EXISTS (SELECT 1 FROM tops t WHERE t.query_id = r.query_id AND t.file_path = r.file_path)),
one AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY weight DESC, score DESC) = 1)
SELECT query_id, file_path, source, priority, CAST(overlap AS INTEGER) AS overlap, score, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, overlap DESC, score DESC, file_path) - 1 AS rank FROM one QUALIFY rank < 5""",
)
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a seed, by how they were reached, what their paths share with the query, and score."""
    ranks, tops, words = _spread(spark, sf_dir)
    source = F.element_at(F.array(F.lit("import"), F.lit("breadcrumb"), F.lit("neighbor")), (F.col("position") % 3 + 1).cast("int"))
    return diversity.explore(ranks.withColumn("source", source), tops, words)


@family.add(
    "w9_best_per_file",
    _SPREAD_SQL
    + f""", x AS (SELECT r.query_id, r.file_path, max(r.score) AS score, any_value({_SHARED_SQL}) AS overlap FROM ranks r JOIN words w ON w.query_id = r.query_id WHERE r.file_path LIKE 'src/%' AND (r.query_id, r.file_path) NOT IN (SELECT (query_id, file_path) FROM tops) GROUP BY ALL)
SELECT query_id, file_path, CAST(overlap AS INTEGER) AS overlap, score, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, score DESC, file_path) - 1 AS rank FROM x QUALIFY rank < 3""",
)
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files under src/ that are not packed yet, by what their paths share with the query and best score."""
    ranks, tops, words = _spread(spark, sf_dir)
    return diversity.primary_files(ranks, tops, words)


_FILL_SQL = (
    _SPREAD_SQL
    + """, have AS (SELECT query_id, count(DISTINCT file_path) AS f, count(DISTINCT file_path) FILTER (WHERE file_path LIKE 'src/%') AS s FROM tops GROUP BY query_id),
fresh AS (SELECT * FROM ranks r WHERE NOT EXISTS (SELECT 1 FROM tops t WHERE t.query_id = r.query_id AND t.file_path = r.file_path) QUALIFY row_number() OVER (PARTITION BY query_id, file_path ORDER BY position) = 1),
line AS (SELECT z.*, h.f + count(*) OVER w AS f_after, h.s + count(*) FILTER (WHERE z.file_path LIKE 'src/%') OVER w AS s_after, h.f AS f0, h.s AS s0 FROM fresh z JOIN have h ON h.query_id = z.query_id WINDOW w AS (PARTITION BY z.query_id ORDER BY z.file_path NOT LIKE 'src/%', z.position)),
last AS (SELECT *, coalesce(lag(f_after) OVER v, f0) AS f_before, coalesce(lag(s_after) OVER v, s0) AS s_before FROM line WINDOW v AS (PARTITION BY query_id ORDER BY file_path NOT LIKE 'src/%', position))
SELECT query_id, file_path, chunk_index, position FROM last WHERE """
)


@family.add("w8_file_diversity_fill", _FILL_SQL + "f_before < 4 OR s_before < 3")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an architecture query's seeds lack of four files, three of them under src/."""
    ranks, tops, _ = _spread(spark, sf_dir)
    return diversity.fill(tops, ranks)


@family.add("w8_source_fill", _FILL_SQL + "file_path LIKE 'src/%' AND s_before < 3")
def w8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a symbol lookup's seeds lack of three files under src/."""
    ranks, tops, _ = _spread(spark, sf_dir)
    return diversity.fill(tops, ranks, files=None)


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: fused recall, path bias, pool, cut-off, neighbours and packing."""
    hits = Q.scaled(spark, sf_dir)
    biased = hits.withColumn("score", F.round(F.col("score") * Q.path_bias(F.col("file_path"), F.lit("architecture"), Q._CANDIDATE), 6))
    pool = fusion.rerank_pool(biased, ["file_path", "chunk_index"])
    seeds = fusion.smart_cutoff(pool.withColumn("position", F.col("n")), ["file_path", "chunk_index"]).select("query_id", "file_path", "chunk_index", "score")
    more = Q.expand.neighbours(seeds, Q.file_chunks(spark, sf_dir)).select("query_id", "file_path", "chunk_index", "score")
    code = X.chunks(spark, sf_dir).select(F.col("path").alias("file_path"), "chunk_index", F.length("code").cast("long").alias("length"))
    rows = seeds.union(more).join(code, ["file_path", "chunk_index"]).select("query_id", "file_path", F.col("chunk_index").alias("start"), "score", "length")
    return fusion.pack(rows)


@family.add("r13_retrieval_pipeline")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pack(spark, sf_dir)


# Symbols of small sources made from documents.
_SOURCES = "SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'typescript' END AS language, CASE WHEN doc_id % 2 = 0 THEN concat('import os\nclass A', cast(doc_id AS string), '(Base):\n    def run(self):\n        return helper(os)\n\ndef helper(x):\n    return x\n') ELSE concat('export class B', cast(doc_id AS string), ' extends Base {{\n}}\nfunction go() {{}}\n') END AS content FROM {f}"


@family.add(
    "g11_symbol_extraction",
    f"""WITH {X.FILES} SELECT kind, count(*) AS n, CAST(sum(start_line) AS BIGINT) AS lines, round(avg(confidence), 6) AS confidence FROM (
SELECT path, unnest([struct_pack(kind := 'IMPORTS', start_line := 1, confidence := 0.6), struct_pack(kind := 'Class', start_line := 2, confidence := 1.0), struct_pack(kind := 'EXTENDS', start_line := 2, confidence := 0.7), struct_pack(kind := 'Method', start_line := 3, confidence := 1.0), struct_pack(kind := 'CALLS', start_line := 4, confidence := 1.0), struct_pack(kind := 'Function', start_line := 6, confidence := 1.0)], recursive := true) FROM files WHERE doc_id % 2 = 0
UNION ALL SELECT path, unnest([struct_pack(kind := 'Class', start_line := 1, confidence := 1.0), struct_pack(kind := 'EXTENDS', start_line := 1, confidence := 0.7), struct_pack(kind := 'Function', start_line := 3, confidence := 1.0)], recursive := true) FROM files WHERE doc_id % 2 = 1) GROUP BY kind""",
)
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols.extract(spark.sql(_SOURCES, f=X.files(spark, sf_dir)))
    return s.groupBy("kind").agg(F.count("*").alias("n"), F.sum("start_line").alias("lines"), F.round(F.avg("confidence"), 6).alias("confidence"))


# Sets and scalar functions.
family.sql(
    "u3_distinct_union", FILES, "SELECT language AS x FROM {f} UNION SELECT split(path, '/')[1] FROM {f}",
    f"WITH {X.FILES} SELECT language AS x FROM files UNION SELECT string_split(path, '/')[2] FROM files",
)
family.sql(
    "u2_bag_union", FILES, "SELECT language AS x, count(*) AS n FROM (SELECT language FROM {f} UNION ALL SELECT language FROM {f} WHERE doc_id % 2 = 0) GROUP BY language",
    f"WITH {X.FILES} SELECT language AS x, count(*) AS n FROM (SELECT language FROM files UNION ALL SELECT language FROM files WHERE doc_id % 2 = 0) GROUP BY language",
)
family.sql(
    "u4_set_difference", FILES, "SELECT hash FROM {f} WHERE doc_id % 2 = 0 EXCEPT SELECT hash FROM {f} WHERE doc_id % 2 = 1",
    f"WITH {X.FILES} SELECT hash FROM files WHERE doc_id % 2 = 0 EXCEPT SELECT hash FROM files WHERE doc_id % 2 = 1",
)
family.sql(
    "u5_set_intersection", FILES, "SELECT hash FROM {f} WHERE doc_id % 2 = 0 INTERSECT SELECT hash FROM {f} WHERE doc_id % 2 = 1",
    f"WITH {X.FILES} SELECT hash FROM files WHERE doc_id % 2 = 0 INTERSECT SELECT hash FROM files WHERE doc_id % 2 = 1",
)
family.sql(
    "u1_recursive_union", {"n": lambda s, d: X.load(s, d, "nation")}, "WITH RECURSIVE w(k, d) AS (SELECT n_nationkey, 0 FROM {n} WHERE n_nationkey % 5 = 0 UNION ALL SELECT n.n_nationkey, d + 1 FROM w JOIN {n} n ON n.n_nationkey = w.k + 1 WHERE d < 3) SELECT k, d FROM w",
    "WITH RECURSIVE w(k, d) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT n.n_nationkey, d + 1 FROM w JOIN nation n ON n.n_nationkey = w.k + 1 WHERE d < 3) SELECT k, d FROM w",
)


@family.add(
    "f_text_functions",
    rf"""SELECT doc_id, substr(md5('/p/' || doc_id), 1, 10) AS project, substr(sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 16) AS content_hash, length(regexp_replace(text, '[ \t\n\r]', '', 'g')) AS solid,
length(left(text, 50)) - length(replace(left(text, 50), chr(10), '')) + 1 AS line, regexp_replace(regexp_replace(lower(source || ' A__b'), '[\s_]+', '-', 'g'), '-+', '-', 'g') AS module, 'src/' || source AS parent, floor((n_chars - 1000.5) / 10.0 + 0.5)::DOUBLE AS rounded FROM documents""",
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, text = X.load(spark, sf_dir, "documents"), F.col("text")
    crumb = F.concat(F.lit("src/"), "source", F.lit(" > x"))
    return d.select(
        "doc_id", T.project_id(F.concat(F.lit("/p/"), F.col("doc_id").cast("string"))).alias("project"), T.content_hash(text).alias("content_hash"), T.solid_length(text).alias("solid"), T.line_of(text, F.lit(50)).alias("line"),
        T.module_name(F.concat("source", F.lit(" A__b"))).alias("module"), T.breadcrumb_parent(crumb).alias("parent"), T.js_round((F.col("n_chars") - 1000.5) / 10.0).alias("rounded"),
    )


_SIGNAL = "concat('outcome=', CASE WHEN doc_id % 2 = 0 THEN 'helpful' ELSE 'memory-stale' END, ' | target = ', source, '=', lang, ' | note | =x | query=', cast(doc_id AS string), CASE WHEN doc_id % 3 = 0 THEN '|query=again' ELSE '' END)"


@family.add("f_map_and_base64url", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'helpful' ELSE 'memory-stale' END AS outcome, source || '=' || lang AS target, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE CAST(doc_id AS VARCHAR) END AS query, CAST(3 AS INTEGER) AS n, rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS code, text AS back FROM documents")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback signals as maps, and texts to base64url and back."""
    d, m = X.load(spark, sf_dir, "documents").withColumn("code", T.base64url(F.col("text"))), T.pairs(F.expr(_SIGNAL))
    return d.select("doc_id", m["outcome"].alias("outcome"), m["target"].alias("target"), m["query"].alias("query"), F.size(m).alias("n"), "code", T.from_base64url(F.col("code")).alias("back"))


@family.add("st9_daily_stream", f"WITH {X.USAGE} SELECT day, count(*) AS calls, round(sum(duration_ms), 4) AS spent, count(*) FILTER (WHERE status = 'error') AS errors FROM usage GROUP BY day")
def st9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series as a stream over the events file, in complete mode."""
    schema = X.load(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    rows = stream.select("ts", F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    name = f"daily_{abs(hash(sf_dir)) % 10**8}"
    E.run_once(E.daily_stream(rows), name, "complete", shared_path(spark, name))
    return spark.table(name)
