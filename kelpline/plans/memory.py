"""Knowledge-base queries: predicates, status, scores, routing, merging, advice, extraction, catalog, handoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import memory as M
from kelpline.operators.fusion import top_k
from kelpline.operators.telemetry import health_score, rate
from kelpline.plans.registry import Family
from kelpline.plans.telemetry import _rate, _round
from kelpline.sources import fixtures as X

family = Family()
MM, FF = {"m": X.memories}, {"f": X.features}


def now():
    return F.lit(X.NOW).cast("timestamp")


_NOW = f"TIMESTAMP '{X.NOW}'"
_STATUS = f"CASE WHEN provenance LIKE 'superseded-by:%' THEN 'superseded' WHEN valid_until + INTERVAL 1 DAY <= {_NOW} THEN 'expired' WHEN {_NOW} - updated_at::TIMESTAMP > INTERVAL 120 DAYS THEN 'stale' ELSE 'active' END"
STATED = f"{X.MEMORIES}, stated AS (SELECT *, {_STATUS} AS status FROM memories)"


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.memories(spark, sf_dir).withColumn("status", M.status(now(), 120))


@family.add("pf10_memory_status", f"WITH {STATED} SELECT id, status FROM stated")
def pf10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, sf_dir).select("id", "status")


@family.add("pf11_prune_predicate", f"WITH {STATED} SELECT id, status FROM stated WHERE status IN ('expired', 'superseded')")
def pf11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated(spark, sf_dir).filter(M.prunable(F.col("status"))).select("id", "status")


family.sql(
    "pf1_dynamic_predicates", MM, "SELECT id FROM {m} WHERE type IN ('fact', 'decision') AND scope = 'project' AND confidence >= 0.3 AND updated_at BETWEEN DATE '2024-02-01' AND DATE '2024-10-01'",
    f"WITH {X.MEMORIES} SELECT id FROM memories WHERE type IN ('fact', 'decision') AND scope = 'project' AND confidence >= 0.3 AND updated_at BETWEEN DATE '2024-02-01' AND DATE '2024-10-01'",
)  # fmt: skip
family.sql(
    "pf2_like_predicates", FF, "SELECT feature_id FROM {f} WHERE name ILIKE '%WID%' OR startswith(dir, 'src/brand1') OR endswith(responsibility, 'ECONOMY')",
    f"WITH {X.FEATURES} SELECT feature_id FROM features WHERE name ILIKE '%WID%' OR dir LIKE 'src/brand1%' OR responsibility LIKE '%ECONOMY'",
)  # fmt: skip

_GLOBS = ["src/brand1/*.ts", "src/**", "src/brand2/", "src/brand17/f3.ts", "lib/**/x.ts"]


@family.add(
    "pf3_trigger_paths",
    f"""WITH {X.FEATURES}, p AS (SELECT feature_id, dir || '/' || files[1] AS path FROM features) SELECT feature_id, 'src/brand1/*.ts' AS trigger FROM p WHERE regexp_matches(path, '^src/brand1/[^/]*\\.ts$') UNION ALL SELECT feature_id, 'src/**' FROM p
UNION ALL SELECT feature_id, 'src/brand2/' FROM p WHERE path LIKE 'src/brand2/%' UNION ALL SELECT feature_id, 'src/brand17/f3.ts' FROM p WHERE path = 'src/brand17/f3.ts' OR path LIKE 'src/brand17/f3.ts/%'""",
)
def pf3(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.features(spark, sf_dir).select("feature_id", F.concat("dir", F.lit("/"), F.col("files")[0]).alias("path"))
    return p.withColumn("trigger", F.explode(F.array(*[F.lit(g) for g in _GLOBS]))).filter(M.path_matches(F.col("path"), F.col("trigger"))).select("feature_id", "trigger")


@family.add(
    "pf4_keyword_predicate",
    f"WITH {X.FEATURES} SELECT feature_id FROM features WHERE len(list_filter(exports, lambda k: contains(lower(k), 'promo') OR contains(lower(k), 'small') OR (contains('smallish', lower(k))))) > 0",
)
def pf4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(spark, sf_dir).filter(M.keyword_matches(F.lit("promo smallish_small"), F.col("exports"))).select("feature_id")


family.sql(
    "pf12_feature_freshness", FF, "SELECT feature_id, stale, conflict, CASE WHEN conflict THEN 'low' WHEN stale THEN 'medium' ELSE 'high' END AS confidence FROM (SELECT feature_id, updated_at < DATE '2025-01-01' - INTERVAL 180 DAYS AS stale, NOT arrays_overlap(files, array('f1.ts', 'f2.ts', 'f3.ts')) AND dir NOT IN ('src/brand1', 'src/brand2') AS conflict FROM {f})",
    f"WITH {X.FEATURES}, x AS (SELECT feature_id, updated_at < DATE '2025-01-01' - INTERVAL 180 DAYS AS stale, NOT list_has_any(files, ['f1.ts', 'f2.ts', 'f3.ts']) AND dir NOT IN ('src/brand1', 'src/brand2') AS conflict FROM features) SELECT *, CASE WHEN conflict THEN 'low' WHEN stale THEN 'medium' ELSE 'high' END AS confidence FROM x",
)  # fmt: skip
_CATEGORY = "CASE WHEN contains(lower(name), 'auth') OR contains(lower(responsibility), 'jwt') THEN 'auth' WHEN contains(lower(name), 'db') OR contains(lower(name), 'database') THEN 'database' WHEN contains(lower(name), 'api') OR contains(lower(responsibility), 'endpoint') THEN 'api' WHEN contains(lower(name), 'search') THEN 'search' WHEN contains(lower(name), 'cache') THEN 'cache' ELSE 'general' END"
_CATNAME = "concat(name, element_at(array(' auth', ' db', ' api', ' search', ' cache', ''), cast(feature_id % 6 + 1 AS int)))"
family.sql(
    "pf13_category", FF, f"SELECT feature_id, {_CATEGORY} AS category FROM (SELECT feature_id, {_CATNAME} AS name, responsibility FROM {{f}})",
    f"WITH {X.FEATURES} SELECT feature_id, {_CATEGORY} AS category FROM (SELECT feature_id, name || ([' auth', ' db', ' api', ' search', ' cache', ''])[feature_id % 6 + 1] AS name, responsibility FROM features)",
)  # fmt: skip
family.sql(
    "pf14_row_coercion", {"u": X.usage}, "SELECT event_id, CASE WHEN tool_name IN ('view', 'click') THEN tool_name ELSE 'other' END AS kind, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reused, try_cast(concat(CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END, cast(k AS string)) AS int) AS n, get(from_json(CASE WHEN k % 5 = 0 THEN 'bad' ELSE concat('[\"a\",\"', cast(k AS string), '\"]') END, 'array<string>'), 0) AS first FROM {u}",
    f"WITH {X.USAGE} SELECT event_id, CASE WHEN tool_name IN ('view', 'click') THEN tool_name ELSE 'other' END AS kind, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reused, TRY_CAST(CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END || k AS INT) AS n, CASE WHEN k % 5 <> 0 THEN 'a' END AS first FROM usage",
)  # fmt: skip

_TERMS = ["user", "t1", "fact-3", "the"]
_ARR = "['user', 't1', 'fact-3', 'the']"
_ANY = "len(list_filter({t}, lambda q: contains(lower(coalesce({f}, '')), q))) > 0"
_SCORED = f"""scored AS (SELECT id, project_id, updated_at, CASE WHEN {_ANY.format(t=_ARR, f="title")} THEN 20 ELSE 0 END + CASE WHEN {_ANY.format(t=_ARR, f="summary")} THEN 12 ELSE 0 END + CASE WHEN {_ANY.format(t=_ARR, f="type")} THEN 2 ELSE 0 END
  + CASE WHEN {_ANY.format(t=_ARR, f="fact_key")} THEN 10 ELSE 0 END + n * 4 + least(10, n * 2) + floor(confidence * 10 + 0.5) + CASE status WHEN 'active' THEN 8 WHEN 'stale' THEN -8 WHEN 'expired' THEN -20 ELSE -16 END
  + CASE WHEN updated_at >= {_NOW} - INTERVAL 7 DAYS THEN 5 WHEN updated_at >= {_NOW} - INTERVAL 30 DAYS THEN 2 ELSE 0 END AS score
  FROM (SELECT *, len(list_filter(tags, lambda g: len(list_filter({_ARR}, lambda q: contains(lower(g), q))) > 0)) AS n FROM stated))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in _TERMS])
    return stated(spark, sf_dir).select("id", "project_id", "updated_at", M.memory_score(terms, F.col("status"), now()).cast("double").alias("score"))


@family.add("r18_memory_search_score", f"WITH {STATED}, {_SCORED} SELECT id, CAST(score AS DOUBLE) AS score FROM scored")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "score")


@family.add("w16_scored_memory_top_k", f"WITH {STATED}, {_SCORED} SELECT project_id, id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, updated_at DESC, id) - 1 AS rank FROM scored QUALIFY rank < 5")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(scored(spark, sf_dir), ["project_id"], [F.col("score").desc(), F.col("updated_at").desc(), "id"], 5).select("project_id", "id", "score", "rank")




@family.add("a16_freshness_grouping_sets", f"WITH {STATED} SELECT coalesce(type, 'all') AS type, coalesce(scope, 'all') AS scope, status, count(*) AS n FROM stated GROUP BY GROUPING SETS ((type, status), (scope, status), (status))")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT coalesce(type, 'all') AS type, coalesce(scope, 'all') AS scope, status, count(*) AS n FROM {m} GROUP BY GROUPING SETS ((type, status), (scope, status), (status))", m=stated(spark, sf_dir))


_HEALTH = f"""h AS (SELECT project_id, {_rate("status = 'stale'")} AS stale, {_rate("status = 'expired'")} AS expired, {_rate("length(title) > 120")} AS orphaned, count(*) FILTER (WHERE length(title) < 10) AS empty, count(DISTINCT type) = 7 AS catalog_ok FROM stated GROUP BY project_id),
hs AS (SELECT project_id, CAST(greatest(0, 100 - CASE WHEN stale > 0.3 THEN 20 ELSE 0 END - CASE WHEN expired > 0.1 THEN 15 ELSE 0 END - CASE WHEN orphaned > 0.2 THEN 15 ELSE 0 END - CASE WHEN NOT catalog_ok THEN 10 ELSE 0 END - CASE WHEN empty > 0 THEN 5 ELSE 0 END) AS INTEGER) AS score FROM h)"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("status")
    h = stated(spark, sf_dir).groupBy("project_id").agg(
        rate(s == "stale").alias("stale"), rate(s == "expired").alias("expired"), rate(F.length("title") > 120).alias("orphaned"), F.count_if(F.length("title") < 10).alias("empty"), (F.count_distinct("type") == 7).alias("catalog_ok")
    )
    return h.select("project_id", health_score(F.col("stale"), F.col("expired"), F.col("orphaned"), F.col("catalog_ok"), F.col("empty")).alias("score"))


@family.add("a17_project_health", f"WITH {STATED}, {_HEALTH} SELECT * FROM hs")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(spark, sf_dir)


@family.add("a18_cross_project_rollup", f"WITH {STATED}, {_HEALTH} SELECT count(*) AS projects, {_round('avg(score)', 2)} AS mean, min(score) AS worst, count(*) FILTER (WHERE score < 60) AS risky FROM hs")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health(spark, sf_dir).agg(F.count("*").alias("projects"), T.js_round(F.avg("score"), 2).alias("mean"), F.min("score").alias("worst"), F.count_if(F.col("score") < 60).alias("risky"))


_FT, _FX = "['small', 'widget', 'econ']", "['red widget', 'promo']"
_FSCORE = f"""CASE WHEN hits > 0 THEN 6 + hits * 2 ELSE 0 END + CASE WHEN list_has_any(list_transform(list_append(exports, name), lambda e: lower(e)), {_FX}) THEN 12 ELSE 0 END
+ CASE WHEN list_has_any(list_transform(files, lambda f: dir || '/' || f), ['src/brand1/f1.ts', 'src/brand2/f2.ts']) THEN 16 WHEN dir IN ('src/brand1', 'src/brand3') THEN 8 ELSE 0 END + CASE confirmation_status WHEN 'human-confirmed' THEN 6 WHEN 'agent-inferred' THEN 2 ELSE -100 END"""


@family.add(
    "r16_feature_memory_rank",
    f"WITH {X.FEATURES}, h AS (SELECT *, len(list_filter({_FT}, lambda t: contains(lower(name || ' ' || responsibility || ' ' || array_to_string(exports, ' ')), t))) AS hits FROM features), s AS (SELECT feature_id, dir, CAST({_FSCORE} AS INTEGER) AS score FROM h) SELECT feature_id, dir, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, feature_id) <= 3",
)
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lits(*xs):
        return F.array(*[F.lit(x) for x in xs])

    score = M.feature_score(lits("small", "widget", "econ"), lits("red widget", "promo"), lits("src/brand1/f1.ts", "src/brand2/f2.ts"), lits("src/brand1", "src/brand3"))
    s = X.features(spark, sf_dir).select("feature_id", "dir", score.cast("int").alias("score")).filter("score > 0")
    return top_k(s, ["dir"], [F.col("score").desc(), "feature_id"], 3).drop("rank")


@family.add(
    "r20_memory_routing",
    f"""WITH {X.FEATURES}, m AS (SELECT feature_id, 'explicit-module' AS matched_by, 0 AS p FROM features WHERE regexp_replace(lower(name), '\\s+', '-', 'g') = 'red-widget' UNION ALL SELECT feature_id, 'path', 1 FROM features WHERE dir = 'src/brand1'
UNION ALL SELECT feature_id, 'keyword', 2 FROM features WHERE len(list_filter(exports, lambda k: contains(lower(k), 'promo'))) > 0 UNION ALL SELECT feature_id, 'explicit-scope', 3 FROM features WHERE dir = 'src/brand7')
SELECT feature_id, matched_by FROM m WHERE matched_by = 'path' UNION ALL SELECT feature_id, matched_by FROM m WHERE matched_by <> 'path' AND (feature_id, p) IN (SELECT (feature_id, min(p)) FROM m GROUP BY feature_id)""",
)
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in order; the first that matches a module counts, and path matches are always added."""
    return routes(spark, sf_dir)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.features(spark, sf_dir)
    rules = [
        ("explicit-module", T.module_name(F.col("name")) == "red-widget"), ("path", M.path_matches(F.concat("dir", F.lit("/x.ts")), F.lit("src/brand1/"))),
        ("keyword", M.keyword_matches(F.lit("promo"), F.col("exports"))), ("explicit-scope", M.scope_of(F.col("dir")) == "brand7"),
    ]  # fmt: skip
    hit = f.select("feature_id", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])).alias("hits")).filter(F.size("hits") > 0)
    first = F.element_at("hits", 1)
    kept = F.array_distinct(F.concat(F.array(first), F.filter("hits", lambda h: h == "path")))
    return hit.select("feature_id", F.explode(kept).alias("matched_by"))


@family.add(
    "r21_module_relevance",
    f"""WITH {X.FEATURES}, m AS (SELECT feature_id, 3.0 AS w FROM features WHERE regexp_replace(lower(name), '\\s+', '-', 'g') = 'red-widget' UNION ALL SELECT feature_id, 2.4 FROM features WHERE dir = 'src/brand1' UNION ALL SELECT feature_id, 2.0 FROM features WHERE feature_id % 3 = 0),
g AS (SELECT feature_id, max(w) + least(1.0, sum(w) - max(w)) AS signal FROM m GROUP BY feature_id)
SELECT f.feature_id, round((2 * signal + CASE WHEN contains(lower(name), 'small') THEN 1.2 ELSE 0 END + greatest(0, 0.2 - (DATE '2025-01-01' - updated_at) / 3650.0) + CASE confirmation_status WHEN 'human-confirmed' THEN 0.6 WHEN 'agent-inferred' THEN 0.15 ELSE -10 END)::DOUBLE, 6) AS relevance FROM g JOIN features f ON f.feature_id = g.feature_id""",
)
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.features(spark, sf_dir)
    m = f.filter(T.module_name(F.col("name")) == "red-widget").select("feature_id", F.lit("explicit-module").alias("matched_by"))
    m = m.union(f.filter("dir = 'src/brand1'").select("feature_id", F.lit("path"))).union(f.filter("feature_id % 3 = 0").select("feature_id", F.lit("keyword")))
    age = F.datediff(F.lit("2025-01-01").cast("date"), "updated_at")
    boost = F.when(F.col("confirmation_status") == "human-confirmed", 0.6).when(F.col("confirmation_status") == "agent-inferred", 0.15).otherwise(-10.0)
    r = M.route_signal(m, ["feature_id"]).join(f, "feature_id")
    query = F.when(F.contains(F.lower("name"), F.lit("small")), 1.2).otherwise(0.0)
    return r.select("feature_id", F.round(2 * F.col("signal") + query + F.greatest(F.lit(0.0), 0.2 - age / 3650.0) + boost, 6).alias("relevance"))


_PT = "list_distinct(list_filter(regexp_split_to_array(lower(summary), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 3))"


@family.add("r22_set_cosine", f"WITH {X.FEATURES} SELECT a.feature_id AS a, b.feature_id AS b, round(len(list_intersect(a.e, b.e)) / sqrt(len(a.e) * len(b.e)), 6) AS cosine FROM (SELECT feature_id, list_distinct(exports) AS e, dir FROM features) a JOIN (SELECT feature_id, list_distinct(exports) AS e, dir FROM features) b ON b.dir = a.dir AND b.feature_id = a.feature_id + 25")
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.features(spark, sf_dir).select("feature_id", "dir", F.array_distinct("exports").alias("e"))
    b = f.select((F.col("feature_id") - 25).alias("feature_id"), "dir", F.col("feature_id").alias("b"), F.col("e").alias("e2"))
    return f.join(b, ["feature_id", "dir"]).select(F.col("feature_id").alias("a"), "b", F.round(T.set_cosine(F.col("e"), F.col("e2")), 6).alias("cosine"))


@family.add(
    "r23_near_duplicate_advice",
    rf"""WITH {X.MEMORIES}, t AS (SELECT id, project_id, type, lower(trim(title)) AS title, lower(trim(summary)) AS summary, list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 4)) AS terms FROM memories),
u AS (SELECT id, project_id, type, len(terms) AS n, unnest(terms) AS term FROM t), p AS (SELECT a.id AS a_id, b.id AS b_id, a.n AS an, b.n AS bn, count(*) AS both_ FROM u a JOIN u b ON b.project_id = a.project_id AND b.type = a.type AND b.term = a.term AND b.id <> a.id GROUP BY ALL),
s AS (SELECT a_id, b_id, round((both_ / greatest(1, least(an, bn)) + CASE WHEN x.title = y.title THEN 0.18 ELSE 0 END + CASE WHEN x.summary = y.summary THEN 0.22 ELSE 0 END + CASE WHEN both_ / (an + bn - both_) >= 0.8 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score FROM p JOIN t x ON x.id = a_id JOIN t y ON y.id = b_id)
SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM s WHERE score >= 0.45 QUALIFY rank <= 3""",
)
def r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(F.filter(T.tokens(F.col("title")), lambda x: F.length(x) >= 4))
    return M.advise(X.memories(spark, sf_dir).select("id", "project_id", "type", "title", "summary", terms.alias("terms")), ["project_id", "type"])


@family.add(
    "r24_memory_merge",
    rf"""WITH {X.MEMORIES}, k AS (SELECT *, coalesce('f:' || fact_key, 'h:' || substr(sha256(trim(regexp_replace(lower(summary), '\s+', ' ', 'g'))), 1, 16)) AS merge_key FROM memories)
SELECT project_id, type, scope, merge_key, count(*) AS merged, md5(last(summary ORDER BY length(summary), id)) AS summary, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, max(updated_at) AS updated_at,
CASE WHEN bool_or(source = 'user-explicit') THEN 'user-explicit' ELSE 'agent-inferred' END AS source FROM k GROUP BY project_id, type, scope, merge_key""",
)
def r24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_memories(X.memories(spark, sf_dir)).withColumn("summary", F.md5("summary")).withColumn("tags", F.array_join("tags", ","))


family.sql(
    "r25_invalidate_and_supersede", MM, "SELECT id, CASE WHEN fact_key = 'fact-4' AND valid_until IS NULL THEN DATE '2025-01-01' ELSE valid_until END AS valid_until, lead(id) OVER (PARTITION BY project_id, type, scope, title ORDER BY updated_at, id) AS superseded_by FROM {m}",
    f"WITH {X.MEMORIES} SELECT id, CASE WHEN fact_key = 'fact-4' AND valid_until IS NULL THEN DATE '2025-01-01' ELSE valid_until END AS valid_until, lead(id) OVER (PARTITION BY project_id, type, scope, title ORDER BY updated_at, id) AS superseded_by FROM memories",
)  # fmt: skip

_RULES = [("reference", "the [a-z]+ing", 0.9), ("feedback", "\\\\b(?:of|les)\\\\b", 0.88), ("preference", "oi", 0.82)]


@family.add(
    "r26_rule_extraction",
    r"""WITH s AS (SELECT conv_id || ':' || turn AS id, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '\s+', ' ', 'g'), '[.!?] *'), lambda x: x <> '')) AS sentence FROM conversations),
r AS (SELECT * FROM (VALUES ('reference', 'the [a-z]+ing', 0.9::DOUBLE), ('feedback', '(?:^| )(?:of|les)(?: |,)', 0.88::DOUBLE), ('preference', 'oi', 0.82::DOUBLE)) t(type, pattern, confidence))
SELECT id, type, sentence, confidence, substr(sha1(type || ':' || sentence), 1, 12) AS memory_id FROM s JOIN r ON regexp_matches(s.sentence, r.pattern)""",
)
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.load(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    found = M.extract(c, [("reference", "the [a-z]+ing", 0.9), ("feedback", "(?:^| )(?:of|les)(?: |,)", 0.88), ("preference", "oi", 0.82)])
    return found.select("id", "type", "sentence", "confidence", "memory_id")


family.sql(
    "r29_wakeup_layers", MM, "SELECT layer, count(*) AS n, min(id) AS first FROM (SELECT id, CASE WHEN scope = 'global-user' THEN 'L0' WHEN type IN ('decision', 'fact') THEN 'L1' WHEN type = 'project-state' THEN 'L2' ELSE 'L3' END AS layer FROM {m}) GROUP BY layer",
    f"WITH {X.MEMORIES} SELECT CASE WHEN scope = 'global-user' THEN 'L0' WHEN type IN ('decision', 'fact') THEN 'L1' WHEN type = 'project-state' THEN 'L2' ELSE 'L3' END AS layer, count(*) AS n, min(id) AS first FROM memories GROUP BY 1",
)  # fmt: skip
family.sql(
    "r28_context_blocks", {**MM, **FF}, "SELECT kind, id, title, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, id) AS position FROM (SELECT 'memory' AS kind, id, title, 2 AS priority FROM {m} WHERE scope = 'project' UNION ALL SELECT 'feature', cast(feature_id AS string), name, 3 FROM {f} WHERE confirmation_status <> 'suggested')",
    f"WITH {X.MEMORIES}, {X.FEATURES}, b AS (SELECT 'memory' AS kind, id, title, 2 AS priority FROM memories WHERE scope = 'project' UNION ALL SELECT 'feature', CAST(feature_id AS VARCHAR), name, 3 FROM features WHERE confirmation_status <> 'suggested') SELECT kind, id, title, row_number() OVER (PARTITION BY kind ORDER BY priority DESC, id) AS position FROM b",
)  # fmt: skip
_READY = "CASE WHEN scope = 'project' THEN 2 ELSE 0 END + CASE WHEN confidence >= 0.3 THEN 1 ELSE 0 END + CASE WHEN fact_key IS NOT NULL THEN 2 ELSE 0 END"
family.sql(
    "r30_phase_boundary", MM, f"SELECT id, ready, CASE WHEN provenance IS NOT NULL THEN 'stay' WHEN ready >= 4 THEN 'advance' WHEN ready >= 2 THEN 'prepare' ELSE 'stay' END AS transition FROM (SELECT id, provenance, {_READY} AS ready FROM {{m}})",
    f"WITH {X.MEMORIES}, r AS (SELECT id, provenance, {_READY} AS ready FROM memories) SELECT id, ready, CASE WHEN provenance IS NOT NULL THEN 'stay' WHEN ready >= 4 THEN 'advance' WHEN ready >= 2 THEN 'prepare' ELSE 'stay' END AS transition FROM r",
)  # fmt: skip
family.sql(
    "j2_index_to_base_join", {**MM, "c": lambda s, d: X.load(s, d, "conversations")}, "SELECT m.id, m.project_id, c.role FROM {m} m JOIN {c} c ON m.id = concat(cast(c.conv_id AS string), ':', cast(c.turn AS string)) WHERE contains(lower(c.text), 'the')",
    f"WITH {X.MEMORIES} SELECT m.id, m.project_id, c.role FROM memories m JOIN conversations c ON m.id = c.conv_id || ':' || c.turn WHERE contains(lower(c.text), 'the')",
)  # fmt: skip
family.sql(
    "j5_exists_semi_join", {**FF, "s": lambda s, d: X.load(s, d, "supplier")}, "SELECT feature_id FROM {f} LEFT SEMI JOIN {s} ON s_suppkey % 25 = feature_id % 25 AND s_acctbal > 9000",
    f"WITH {X.FEATURES} SELECT feature_id FROM features f WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 25 = f.feature_id % 25 AND s_acctbal > 9000)",
)  # fmt: skip
family.sql(
    "j16_evidence_back_reference", MM, "SELECT id, ref, m2.title IS NOT NULL AS resolved, 100 AS score FROM (SELECT id, explode(array(concat('evidence:', split(id, ':')[0], ':0'), 'evidence:none')) AS ref FROM {m}) LEFT JOIN (SELECT id AS i2, title FROM {m}) m2 ON concat('evidence:', m2.i2) = ref",
    f"WITH {X.MEMORIES}, r AS (SELECT id, unnest(['evidence:' || split_part(id, ':', 1) || ':0', 'evidence:none']) AS ref FROM memories) SELECT r.id, r.ref, m.title IS NOT NULL AS resolved, 100 AS score FROM r LEFT JOIN memories m ON 'evidence:' || m.id = r.ref",
)  # fmt: skip
family.sql(
    "j18_changed_path_to_memories", FF, "SELECT feature_id, CASE WHEN array_contains(files, 'f7.ts') THEN 'direct' WHEN dir = 'src/brand9' THEN 'route' END AS reason FROM {f} WHERE array_contains(files, 'f7.ts') OR dir = 'src/brand9'",
    f"WITH {X.FEATURES} SELECT feature_id, CASE WHEN list_contains(files, 'f7.ts') THEN 'direct' WHEN dir = 'src/brand9' THEN 'route' END AS reason FROM features WHERE list_contains(files, 'f7.ts') OR dir = 'src/brand9'",
)  # fmt: skip
family.sql(
    "j19_unique_name_lookup", FF, "SELECT name, min(feature_id) AS feature_id, count(*) = 1 AS unique FROM {f} GROUP BY name",
    f"WITH {X.FEATURES} SELECT name, min(feature_id) AS feature_id, count(*) = 1 AS unique FROM features GROUP BY name",
)  # fmt: skip
# Asks for features by path: records, whole paths, bare names, ends of paths.
_WANTED = "SELECT p_partkey AS request_id, CASE p_partkey % 5 WHEN 0 THEN concat('/features/', replace(p_name, ' ', '-'), '.json') WHEN 1 THEN concat('src\\\\', lower(replace(p_brand, '#', '')), '\\\\f', cast(p_partkey % 40 AS string), '.ts') WHEN 2 THEN concat('f', cast(p_partkey AS string), '.ts') WHEN 3 THEN concat(lower(replace(p_brand, '#', '')), '/f', cast(p_partkey % 40 AS string), '.ts') ELSE concat('brand', cast(p_partkey AS string), '/f1.ts') END AS path FROM {p}"


@family.add(
    "j19_path_lookup",
    f"""WITH {X.FEATURES}, r AS (SELECT p_partkey AS request_id, p_partkey % 5 AS k, CASE p_partkey % 5 WHEN 0 THEN 'features/' || replace(p_name, ' ', '-') WHEN 1 THEN 'src/' || lower(replace(p_brand, '#', '')) || '/f' || (p_partkey % 40) || '.ts' WHEN 2 THEN 'f' || p_partkey || '.ts' WHEN 3 THEN lower(replace(p_brand, '#', '')) || '/f' || (p_partkey % 40) || '.ts' ELSE 'brand' || p_partkey || '/f1.ts' END AS want FROM part),
c AS (SELECT feature_id AS id, dir || '/' || files[1] AS path, files[1] AS base, 'features/' || regexp_replace(regexp_replace(trim(lower(name)), '[\\s_]+', '-', 'g'), '-+', '-', 'g') AS record FROM features),
f AS (SELECT r.request_id, k, min(c.id) AS id, count(*) AS n FROM r JOIN c ON CASE k WHEN 0 THEN c.record = r.want WHEN 1 THEN c.path = r.want WHEN 2 THEN c.base = r.want ELSE c.path LIKE '%/' || r.want END GROUP BY ALL)
SELECT r.request_id, CASE WHEN f.n = 1 OR f.k < 2 THEN (['record', 'exact', 'basename', 'suffix', 'suffix'])[r.k + 1] END AS tier, CASE WHEN f.n = 1 OR f.k < 2 THEN f.id END AS id FROM r LEFT JOIN f ON f.request_id = r.request_id""",
)
def j19b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by record, whole path, the one file of a name, or the one path with an end."""
    memories = X.features(spark, sf_dir).select(F.col("feature_id").alias("id"), "name", "dir", "files")
    return M.find_by_path(spark.sql(_WANTED, p=X.load(spark, sf_dir, "part")), memories)


family.sql(
    "x6_handoff_references", {**MM, **FF}, "SELECT ref, kind, coalesce(m.title, f.name) AS title, m.id IS NULL AND f.feature_id IS NULL AS unresolved FROM (SELECT DISTINCT concat(k, ':', i) AS ref, k AS kind, i AS key FROM (SELECT 'memory' AS k, id AS i FROM {m} UNION ALL SELECT 'feature', cast(feature_id * 3 AS string) FROM {f})) LEFT JOIN {m} m ON kind = 'memory' AND m.id = key LEFT JOIN {f} f ON kind = 'feature' AND cast(f.feature_id AS string) = key",
    f"WITH {X.MEMORIES}, {X.FEATURES}, r AS (SELECT DISTINCT k || ':' || i AS ref, k AS kind, i AS key FROM (SELECT 'memory' AS k, id AS i FROM memories UNION ALL SELECT 'feature', CAST(feature_id * 3 AS VARCHAR) FROM features)) SELECT ref, kind, coalesce(m.title, f.name) AS title, m.id IS NULL AND f.feature_id IS NULL AS unresolved FROM r LEFT JOIN memories m ON kind = 'memory' AND m.id = key LEFT JOIN features f ON kind = 'feature' AND CAST(f.feature_id AS VARCHAR) = key",
)  # fmt: skip
family.sql(
    "x7_diary_lookup", MM, "SELECT project_id, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) AS n FROM {m} WHERE array_contains(tags, 'user') AND array_contains(tags, 't0')) WHERE n <= 3",
    f"WITH {X.MEMORIES} SELECT project_id, id FROM memories WHERE list_contains(tags, 'user') AND list_contains(tags, 't0') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id) <= 3",
)  # fmt: skip
family.sql(
    "x8_memory_suggestions", {"c": lambda s, d: X.load(s, d, "conversations")}, "SELECT fact_key, line FROM (SELECT *, row_number() OVER (PARTITION BY fact_key ORDER BY conv_id DESC, turn DESC, pos DESC) AS n FROM (SELECT conv_id, turn, pos, line, concat(CASE WHEN line RLIKE 'the' THEN 'preference-' ELSE 'state-' END, cast(length(line) % 50 AS string)) AS fact_key FROM (SELECT conv_id, turn, posexplode(split(text, '\n')) AS (pos, line) FROM {c}) WHERE line RLIKE 'the|de')) WHERE n = 1",
    "WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS a FROM conversations), x AS (SELECT conv_id, turn, i AS pos, a[i + 1] AS line FROM l, unnest(range(len(a))) t(i)), k AS (SELECT *, CASE WHEN contains(line, 'the') THEN 'preference-' ELSE 'state-' END || (length(line) % 50) AS fact_key FROM x WHERE contains(line, 'the') OR contains(line, 'de')) SELECT fact_key, line FROM k QUALIFY row_number() OVER (PARTITION BY fact_key ORDER BY conv_id DESC, turn DESC, pos DESC) = 1",
)  # fmt: skip
_MODULES = "SELECT regexp_replace(lower(name), '\\\\s+', '-') AS module, concat('src-', split(dir, '/')[1]) AS scope, feature_id, exports FROM {f}"


@family.add("x9_catalog_build", f"WITH {X.FEATURES} SELECT substr(dir, 5) AS scope, count(DISTINCT replace(name, ' ', '-')) AS modules, array_to_string(list_slice(list_sort(list_distinct(flatten(list(list_append(exports, name))))), 1, 4), ',') AS keywords FROM features GROUP BY dir")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.features(spark, sf_dir)
    k = f.select(M.scope_of(F.col("dir")).alias("scope"), T.module_name(F.col("name")).alias("module"), F.explode(F.array_append("exports", F.col("name"))).alias("keyword"))
    return k.groupBy("scope").agg(F.count_distinct("module").alias("modules"), F.array_join(F.slice(F.array_sort(F.collect_set("keyword")), 1, 4), ",").alias("keywords"))


family.sql(
    "x10_catalog_listing", FF, "SELECT dir, count(*) AS n FROM {f} WHERE dir LIKE 'src/brand2%' GROUP BY dir",
    f"WITH {X.FEATURES} SELECT dir, count(*) AS n FROM features WHERE dir LIKE 'src/brand2%' GROUP BY dir",
)  # fmt: skip
family.sql(
    "x11_catalog_consistency", FF, "SELECT 'missing' AS kind, name FROM (SELECT name FROM {f} WHERE feature_id % 2 = 0 EXCEPT SELECT name FROM {f} WHERE feature_id % 7 = 1) UNION ALL SELECT 'stale', name FROM (SELECT concat(name, '-old') AS name FROM {f} WHERE feature_id % 50 = 1 EXCEPT SELECT name FROM {f})",
    f"WITH {X.FEATURES} SELECT 'missing' AS kind, name FROM (SELECT name FROM features WHERE feature_id % 2 = 0 EXCEPT SELECT name FROM features WHERE feature_id % 7 = 1) UNION ALL SELECT 'stale', name FROM (SELECT name || '-old' AS name FROM features WHERE feature_id % 50 = 1 EXCEPT SELECT name FROM features)",
)  # fmt: skip
family.sql(
    "x12_module_resolution_order", FF, "SELECT key, feature_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, feature_id) AS n FROM (SELECT q.key, f.feature_id, 0 AS tier FROM VALUES ('red widget'), ('RED-WIDGET'), ('economy') AS q(key) JOIN {f} f ON f.name = q.key UNION ALL SELECT q.key, f.feature_id, 1 FROM VALUES ('red widget'), ('RED-WIDGET'), ('economy') AS q(key) JOIN {f} f ON replace(lower(f.name), ' ', '-') = replace(lower(q.key), ' ', '-') UNION ALL SELECT q.key, f.feature_id, 2 FROM VALUES ('red widget'), ('RED-WIDGET'), ('economy') AS q(key) JOIN {f} f ON exists(f.exports, e -> lower(e) = lower(q.key)))) WHERE n = 1",
    f"WITH {X.FEATURES}, q AS (SELECT * FROM (VALUES ('red widget'), ('RED-WIDGET'), ('economy')) t(key)), c AS (SELECT q.key, f.feature_id, 0 AS tier FROM q JOIN features f ON f.name = q.key UNION ALL SELECT q.key, f.feature_id, 1 FROM q JOIN features f ON replace(lower(f.name), ' ', '-') = replace(lower(q.key), ' ', '-') UNION ALL SELECT q.key, f.feature_id, 2 FROM q JOIN features f ON len(list_filter(f.exports, lambda e: lower(e) = lower(q.key))) > 0) SELECT key, feature_id, tier FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, feature_id) = 1",
)  # fmt: skip
family.sql(
    "x21_catalog_maintenance", FF, "SELECT scope, count(*) AS modules FROM (SELECT dir AS scope, name FROM {f} WHERE feature_id % 3 <> 0 UNION SELECT 'src/new', name FROM {f} WHERE feature_id % 400 = 0) GROUP BY scope",
    f"WITH {X.FEATURES} SELECT scope, count(*) AS modules FROM (SELECT dir AS scope, name FROM features WHERE feature_id % 3 <> 0 UNION SELECT 'src/new', name FROM features WHERE feature_id % 400 = 0) GROUP BY scope",
)  # fmt: skip
family.sql(
    "a29_route_breakdown", {"r": routes}, "SELECT matched_by, count(*) AS n FROM {r} GROUP BY matched_by",
    "WITH r AS (" + family.oracles["r20_memory_routing"].replace("WITH ", "WITH ", 1) + ") SELECT matched_by, count(*) AS n FROM r GROUP BY matched_by",
)  # fmt: skip


@family.add("w15_mmr_selection")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight diverse memories a project and type out of its best forty."""
    pool = top_k(scored(spark, sf_dir).join(stated(spark, sf_dir).select("id", "type", "title"), "id"), ["project_id", "type"], [F.col("score").desc(), "id"], 40)
    c = pool.select(F.concat_ws("/", "project_id", "type").alias("query_id"), "id", F.col("score").alias("relevance"), F.array_distinct(T.tokens(F.col("title"))).alias("terms"))
    return M.mmr(c, 8, 0.7)


@family.add(
    "c1_line_splitter",
    rf"""WITH RECURSIVE {X.FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files), ln AS (SELECT path, i, l[i + 1] AS line FROM l, unnest(range(len(l))) t(i)),
x AS (SELECT path, i, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) - length(line) - 1 AS at_, length(line) AS n, length(regexp_replace(line, '[ 	]', '', 'g')) AS solid FROM ln),
s(path, i, k, start, size) AS (SELECT path, i, 0, 0::HUGEINT, solid FROM x WHERE i = 0 UNION ALL SELECT x.path, x.i, CASE WHEN size + solid > 500 THEN k + 1 ELSE k END, CASE WHEN size + solid > 500 THEN at_ ELSE start END, CASE WHEN size + solid > 500 THEN solid ELSE size + solid END FROM s JOIN x ON x.path = s.path AND x.i = s.i + 1)
SELECT path, CAST(k AS INTEGER) AS chunk_index, CAST(min(start) AS INTEGER) AS start, CAST(max(at_ + n) AS INTEGER) AS "end" FROM s JOIN x USING (path, i) GROUP BY path, k""",
)
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_lines(X.files(spark, sf_dir), "path", "content", 500)
