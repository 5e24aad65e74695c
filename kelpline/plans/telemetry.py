"""Telemetry queries: usage rates, percentiles, series, alerts, scores, log parsing, queue reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.functions.text import js_round
from kelpline.operators import telemetry as M
from kelpline.plans.registry import Family
from kelpline.sources import fixtures as X
from kelpline.sources import logs
from kelpline.streaming.tasks import EVENTS, decided

family = Family()

U = {"u": X.usage}


def _round(x: str, digits: int) -> str:
    f = 10**digits
    return f"floor(({x}) * {f}.0::DOUBLE + 0.5) / {f}.0::DOUBLE"


def _rate(p: str, digits: int = 4) -> str:
    return _round(f"coalesce(avg(CASE WHEN {p} THEN 1.0::DOUBLE ELSE 0.0 END), 0.0)", digits)


family.sql("a1_count_by_group", U, "SELECT tool_name, count(*) AS n FROM {u} GROUP BY tool_name", f"WITH {X.USAGE} SELECT tool_name, count(*) AS n FROM usage GROUP BY tool_name")
family.sql(
    "a2_count_distinct", U, "SELECT tool_name, count(DISTINCT project_id) AS projects, count(DISTINCT day) AS days FROM {u} GROUP BY tool_name",
    f"WITH {X.USAGE} SELECT tool_name, count(DISTINCT project_id) AS projects, count(DISTINCT day) AS days FROM usage GROUP BY tool_name",
)


@family.add(
    "a3_conditional_aggregates",
    f"WITH {X.USAGE} SELECT tool_name, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN index_state = 'missing' THEN 1 ELSE 0 END) AS BIGINT) AS missing, {_round('avg(duration_ms)', 3)} AS mean FROM usage GROUP BY tool_name",
)
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.usage(spark, sf_dir)
    return u.groupBy("tool_name").agg(F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("index_state") == "missing").alias("missing"), js_round(F.avg("duration_ms"), 3).alias("mean"))


_BY_PROJECT = f"{_rate("index_state = 'missing'")} AS missing_rate, {_rate("status = 'error'")} AS error_rate"


@family.add("a4_rates", f"WITH {X.USAGE} SELECT project_id, {_BY_PROJECT} FROM usage GROUP BY project_id")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.usage(spark, sf_dir).groupBy("project_id").agg(M.rate(F.col("index_state") == "missing").alias("missing_rate"), M.rate(F.col("status") == "error").alias("error_rate"))


@family.add(
    "a5_nearest_rank_percentiles",
    f"WITH {X.USAGE} SELECT tool_name, count(*) AS n, round(avg(duration_ms), 6) AS mean, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM usage GROUP BY tool_name",
)
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.percentiles_by(X.usage(spark, sf_dir), ["tool_name"], "duration_ms", {"p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 6))


@family.add("a6_stage_share", f"WITH {X.USAGE}, s AS (SELECT tool_name, sum(duration_ms) AS spent FROM usage GROUP BY tool_name) SELECT tool_name, {_round('spent / sum(spent) OVER ()', 4)} AS share FROM s")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.usage(spark, sf_dir).groupBy("tool_name").agg(F.sum("duration_ms").alias("spent"))
    return s.select("tool_name", M.share(F.col("spent"), F.sum("spent").over(Window.partitionBy())).alias("share"))


family.sql(
    "a7_breakdown_with_unknown", U, "SELECT coalesce(CASE WHEN k % 5 = 0 THEN NULL ELSE index_state END, 'unknown') AS state, count(*) AS n FROM {u} GROUP BY 1",
    f"WITH {X.USAGE} SELECT coalesce(CASE WHEN k % 5 = 0 THEN NULL ELSE index_state END, 'unknown') AS state, count(*) AS n FROM usage GROUP BY 1",
)


@family.add(
    "a8_exploded_top_k",
    "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, w LIMIT 5",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(5)


DAILY = f"SELECT day, count(*) AS calls, {_round('avg(duration_ms)', 2)} AS avg_ms, {_rate("status = 'error'")} AS error_rate, {_rate("index_state = 'missing'")} AS missing_rate FROM usage GROUP BY day"


@family.add("a9_daily_series", f"WITH {X.USAGE} {DAILY}")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.daily(X.usage(spark, sf_dir))


@family.add(
    "a10_hot_projects",
    f"WITH {X.USAGE} SELECT project_id, count(*) AS n, min_by(tool_name, event_id) FILTER (WHERE k > 10) AS first_tool, {_rate("index_state = 'missing'")} AS missing_rate FROM usage GROUP BY project_id ORDER BY n DESC, project_id LIMIT 10",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.usage(spark, sf_dir)
    first = F.min_by(F.when(F.col("k") > 10, F.col("tool_name")), F.when(F.col("k") > 10, F.col("event_id")))
    g = u.groupBy("project_id").agg(F.count("*").alias("n"), first.alias("first_tool"), M.rate(F.col("index_state") == "missing").alias("missing_rate"))
    return g.orderBy(F.col("n").desc(), "project_id").limit(10)


@family.add(
    "a11_index_kpis",
    f"""WITH {X.USAGE} SELECT count(*) AS calls, {_round("coalesce(avg(CASE WHEN index_state = 'missing' THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE tool_name = 'view'), 0.0)", 4)} AS query_before_index,
{_round("coalesce(avg(CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE tool_name = 'click'), 0.0)", 4)} AS reused, {_rate("k % 7 = 0")} AS full_index, {_round("coalesce(avg(coalesce(duration_ms, 0.0)) FILTER (WHERE tool_name = 'purchase'), 0.0)", 2)} AS avg_ms FROM usage""",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of conditional aggregates; the full-index rate is over all rows, as its siblings are not."""

    def among(test, of):
        return js_round(F.coalesce(F.avg(F.when(of, F.when(test, 1.0).otherwise(0.0))), F.lit(0.0)), 4)

    u, tool = X.usage(spark, sf_dir), F.col("tool_name")
    mean = js_round(F.coalesce(F.avg(F.when(tool == "purchase", F.coalesce("duration_ms", F.lit(0.0)))), F.lit(0.0)), 2)
    return u.agg(
        F.count("*").alias("calls"), among(F.col("index_state") == "missing", tool == "view").alias("query_before_index"), among(F.col("k") % 2 == 0, tool == "click").alias("reused"),
        M.rate(F.col("k") % 7 == 0).alias("full_index"), mean.alias("avg_ms"),
    )


OPS = f"""all_ AS (SELECT {_rate("status = 'success'")} AS s FROM usage WHERE tool_name IN ('view', 'error')), g AS (SELECT project_id, count(*) FILTER (WHERE tool_name IN ('view', 'error')) AS n,
  {_round("avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE tool_name IN ('view', 'error'))", 4)} AS s, {_rate("k % 10 = 0")} AS empty, {_rate("index_state = 'stale'")} AS stale, {_rate("k % 8 = 0")} AS failed FROM usage GROUP BY project_id),
ops AS (SELECT project_id, CASE WHEN n > 0 THEN g.s ELSE all_.s END AS success, empty, stale, failed FROM g CROSS JOIN all_)"""


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by project; one without calls falls back to the rate over all."""
    u = X.usage(spark, sf_dir)
    of, ok = F.col("tool_name").isin("view", "error"), F.when(F.col("status") == "success", 1.0).otherwise(0.0)
    whole = u.filter(of).agg(M.rate(F.col("status") == "success").alias("s_all"))
    g = u.groupBy("project_id").agg(F.count_if(of).alias("n"), js_round(F.avg(F.when(of, ok)), 4).alias("s"), M.rate(F.col("k") % 10 == 0).alias("empty"), M.rate(F.col("index_state") == "stale").alias("stale"), M.rate(F.col("k") % 8 == 0).alias("failed"))
    return g.join(F.broadcast(whole)).select("project_id", F.when(F.col("n") > 0, F.col("s")).otherwise(F.col("s_all")).alias("success"), "empty", "stale", "failed")


@family.add("a12_ops_kpis", f"WITH {X.USAGE}, {OPS} SELECT * FROM ops")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir)


_SCORE = _round("(success * 0.35 + (1 - empty) * 0.25 + (1 - stale) * 0.2 + (1 - failed) * 0.2) * 100", 1)
_BAND = "CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 60 THEN 'watch' ELSE 'risky' END"


@family.add("a13_weighted_scores", f"WITH {X.USAGE}, {OPS}, s AS (SELECT project_id, {_SCORE} AS score FROM ops) SELECT project_id, score, {_BAND} AS band FROM s")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = M.repo_score(F.col("success"), F.col("empty"), F.col("stale"), F.col("failed"))
    return ops(spark, sf_dir).select("project_id", score.alias("score")).withColumn("band", M.band(F.col("score")))


_FEEDBACK = "SELECT project_id, concat('outcome=', CASE k % 4 WHEN 0 THEN 'helpful' WHEN 1 THEN 'memory-stale' WHEN 2 THEN 'wrong-module' ELSE 'not-helpful' END, ' | target=m', cast(k % 6 AS string), ' | note=a=b') AS feedback FROM {u}"
_FEEDBACK_SQL = "f AS (SELECT project_id, 'outcome=' || CASE k % 4 WHEN 0 THEN 'helpful' WHEN 1 THEN 'memory-stale' WHEN 2 THEN 'wrong-module' ELSE 'not-helpful' END || ' | target=m' || (k % 6) || ' | note=a=b' AS feedback FROM usage)"


@family.add(
    "a14_feedback_rates",
    f"WITH {X.USAGE}, {_FEEDBACK_SQL}, p AS (SELECT regexp_extract(feedback, 'target=([^|]+?) *[|]', 1) AS module, regexp_extract(feedback, 'outcome=([a-z-]+)', 1) AS outcome, regexp_extract(feedback, 'note=(.*)$', 1) AS note FROM f) SELECT module, note, {_rate("outcome = 'memory-stale'")} AS stale_rate, {_rate("outcome IN ('wrong-module', 'not-helpful')")} AS correction_rate FROM p GROUP BY module, note",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.sql(_FEEDBACK, u=X.usage(spark, sf_dir))
    p = f.select(logs.key_values(F.col("feedback")).alias("m")).select(F.col("m.target").alias("module"), F.col("m.outcome").alias("outcome"), F.col("m.note").alias("note"))
    return p.groupBy("module", "note").agg(M.rate(F.col("outcome") == "memory-stale").alias("stale_rate"), M.rate(F.col("outcome").isin("wrong-module", "not-helpful")).alias("correction_rate"))


family.sql(
    "a15_governance_distribution", {"c": lambda s, d: X.load(s, d, "customer")},
    "SELECT count_if(c_mktsegment = 'MACHINERY') AS readonly, count_if(c_mktsegment <> 'MACHINERY') AS editable, count_if(c_acctbal < 0) AS disabled, count_if(c_acctbal >= 0 AND c_nationkey % 2 = 0) AS project_scope, count_if(c_acctbal >= 0 AND c_nationkey % 2 = 1) AS global_scope FROM {c}",
    "SELECT count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS readonly, count(*) FILTER (WHERE c_mktsegment <> 'MACHINERY') AS editable, count(*) FILTER (WHERE c_acctbal < 0) AS disabled, count(*) FILTER (WHERE c_acctbal >= 0 AND c_nationkey % 2 = 0) AS project_scope, count(*) FILTER (WHERE c_acctbal >= 0 AND c_nationkey % 2 = 1) AS global_scope FROM customer",
)
family.sql(
    "a19_usage_database_stats", U, "SELECT count(*) AS n, min(day) AS first_day, max(day) AS last_day, source FROM (SELECT day, 'tool' AS source FROM {u} UNION ALL SELECT day, 'index' FROM {u} WHERE k % 3 = 0) GROUP BY source",
    f"WITH {X.USAGE} SELECT count(*) AS n, min(day) AS first_day, max(day) AS last_day, source FROM (SELECT day, 'tool' AS source FROM usage UNION ALL SELECT day, 'index' FROM usage WHERE k % 3 = 0) GROUP BY source",
)


@family.add(
    "a24_provider_rollup",
    f"WITH {X.USAGE} SELECT tool_name AS provider, count(*) AS requests, count(*) FILTER (WHERE k % 9 = 0) AS failures, {_round('avg(CASE WHEN k % 9 <> 0 THEN duration_ms END)', 2)} AS latency_ms, {_rate('k % 9 <> 0')} AS success_rate FROM usage GROUP BY tool_name",
)
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("k") % 9 == 0
    g = X.usage(spark, sf_dir).groupBy(F.col("tool_name").alias("provider"))
    return g.agg(F.count("*").alias("requests"), F.count_if(failed).alias("failures"), js_round(F.avg(F.when(~failed, F.col("duration_ms"))), 2).alias("latency_ms"), M.rate(~failed).alias("success_rate"))


# Alert rules: fixed values.
RULES = [
    ("queue-backlog", "queue.queued", ">", 5.0, "warning"),
    ("stale-queue", "queue.oldestAgeMinutes", ">", 30.0, "critical"),
    ("index-failure", "queue.failed", ">", 0.0, "critical"),
    ("no-seed-rate", "retrieval.noSeedRate", ">", 0.2, "warning"),
    ("budget-exhausted", "retrieval.budgetExhaustedRate", ">", 0.3, "warning"),
    ("db-corrupted", "snapshot.corruptedCount", ">", 0.0, "critical"),
    ("daemon-down", "daemon.isRunning", "==", 0.0, "warning"),
    ("mcp-duplicate-processes", "mcp.duplicateCount", ">", 0.0, "warning"),
    ("memory-high-stale-rate", "memory.staleRate", ">", 0.3, "warning"),
    ("memory-high-expired-rate", "memory.expiredRate", ">", 0.1, "critical"),
    ("memory-orphaned-features", "memory.orphanedRate", ">", 0.2, "warning"),
    ("memory-catalog-inconsistent", "memory.catalogInconsistent", "==", 1.0, "warning"),
]
_RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{m}', '{o}', {t}::DOUBLE, '{s}')" for i, m, o, t, s in RULES) + ") AS r(rule_id, metric, operator, threshold, severity))"
_METRICS = [("queue.queued", "count_if(k % 4 = 0)", "count(*) FILTER (WHERE k % 4 = 0)"), ("retrieval.noSeedRate", "avg(CASE WHEN k % 5 = 0 THEN 1.0D ELSE 0.0D END)", "avg(CASE WHEN k % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0 END)"), ("memory.staleRate", "avg(CASE WHEN index_state = 'stale' THEN 1.0D ELSE 0.0D END)", "avg(CASE WHEN index_state = 'stale' THEN 1.0::DOUBLE ELSE 0.0 END)"), ("memory.catalogInconsistent", "max(cast(k = 7 AS int))", "max(CAST(k = 7 AS INT))")]


def rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{i}', '{m}', '{o}', {t}D, '{s}', true)" for i, m, o, t, s in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(rule_id, metric, operator, threshold, severity, enabled)")


METRICS = "metrics AS (" + " UNION ALL ".join(f"SELECT project_id AS project, '{n}' AS metric, round(CAST({d} AS DOUBLE), 9) AS value FROM usage GROUP BY project_id" for n, _, d in _METRICS) + ")"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide report rows, flattened to (project, metric, value)."""
    wide = X.usage(spark, sf_dir).groupBy("project_id").agg(*[F.round(F.expr(s).cast("double"), 9).alias(n) for n, s, _ in _METRICS])
    return wide.select(F.col("project_id").alias("project"), F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n, *_ in _METRICS]), F.array(*[F.col(f"`{n}`") for n, *_ in _METRICS]))).alias("metric", "value"))


@family.add("x15_metric_flattening", f"WITH {X.USAGE}, {METRICS} SELECT * FROM metrics")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


@family.add(
    "pf15_alert_rules",
    f"""WITH {X.USAGE}, {METRICS}, {_RULES_SQL}, g AS (SELECT p.project, r.*, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT project FROM metrics) p CROSS JOIN rules r LEFT JOIN metrics m ON m.project = p.project AND m.metric = r.metric)
SELECT project, rule_id, severity, value, threshold FROM g WHERE CASE operator WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold WHEN '==' THEN value = threshold ELSE false END""",
)
def pf15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.alerts(metrics(spark, sf_dir), rules(spark))


@family.add(
    "w13_first_last_trend",
    f"""WITH {X.USAGE}, d AS ({DAILY}), e AS (SELECT first_value(avg_ms) OVER w AS a, last_value(avg_ms) OVER w AS b, first_value(error_rate) OVER w AS x, last_value(error_rate) OVER w AS y FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) LIMIT 1)
SELECT a AS first_ms, b AS last_ms, b >= a * 1.2 AS slower, y - x >= 0.15 AS more_errors FROM e""",
)
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.daily(X.usage(spark, sf_dir)).agg(*[f(c, "day").alias(n) for n, f, c in (("a", F.min_by, "avg_ms"), ("b", F.max_by, "avg_ms"), ("x", F.min_by, "error_rate"), ("y", F.max_by, "error_rate"))])
    return d.select(F.col("a").alias("first_ms"), F.col("b").alias("last_ms"), (F.col("b") >= F.col("a") * 1.2).alias("slower"), (F.col("y") - F.col("x") >= 0.15).alias("more_errors"))


@family.add(
    "w14_latest_windows",
    f"""WITH {X.USAGE} SELECT 'days' AS kind, count(*) AS n FROM usage WHERE day IN (SELECT DISTINCT day FROM usage ORDER BY day DESC LIMIT 3)
UNION ALL SELECT 'hours', count(*) FROM usage WHERE ts >= (SELECT max(ts) FROM usage) - INTERVAL 48 HOURS""",
)
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.usage(spark, sf_dir)
    a = M.latest_days(u, 3).agg(F.count("*").alias("n")).select(F.lit("days").alias("kind"), "n")
    return a.union(M.hours_back(u, 48).agg(F.count("*").alias("n")).select(F.lit("hours"), "n"))


# Log lines made from events and parsed back; every ninth is cut off, every tenth has no marker.
_JSON = """concat('{"requestId":"r', cast(event_id AS string), '","projectId":"', project_id, '","totalMs":', cast(duration_ms AS string), ',"seedCount":', cast(k % 5 AS string), ',"timingMs":{"recall":', cast(k AS string), ',"rerank":', cast(k % 7 AS string), '}}')"""
_JSON = _JSON.replace("{", "{{").replace("}", "}}")
LOG_LINES = f"SELECT event_id, day, concat('[INFO] ', CASE WHEN k % 10 = 0 THEN 'other' ELSE 'retrieval completed' END, ' ', CASE WHEN k % 9 = 0 THEN left({_JSON}, 30) ELSE {_JSON} END) AS line FROM {{u}}"
_LOG_FIELDS = "request_id, project_id, total_ms, seed_count, recall, rerank"


@family.add(
    "sc10_log_line_parse",
    f"WITH {X.USAGE} SELECT 'r' || event_id AS request_id, project_id, duration_ms AS total_ms, k % 5 AS seed_count, CAST(k AS DOUBLE) AS recall, CAST(k % 7 AS DOUBLE) AS rerank FROM usage WHERE k % 10 <> 0 AND k % 9 <> 0",
)
def sc10(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(LOG_LINES, u=X.usage(spark, sf_dir))
    return logs.parse_lines(lines, "line", ["retrieval completed"]).select(*_LOG_FIELDS.split(", "))


@family.add(
    "sc9_log_directory_scan",
    f"WITH {X.USAGE}, d AS (SELECT day, dense_rank() OVER (ORDER BY day DESC) AS r FROM usage) SELECT 'app.' || day || '.log' AS file, count(*) AS n FROM d WHERE r <= 7 GROUP BY day",
)
def sc9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven files by name of a directory listing, with their lines."""
    lines = X.usage(spark, sf_dir).select(F.concat(F.lit("/logs/app."), "day", F.lit(".log")).alias("path"))
    return logs.latest_files(lines, "path", 7).groupBy("file").agg(F.count("*").alias("n"))


family.sql(
    "sc11_usage_scan_coercion", U, "SELECT event_id, CASE WHEN tool_name IN ('view', 'click', 'purchase') THEN 'success' ELSE 'error' END AS status, day FROM {u}",
    f"WITH {X.USAGE} SELECT event_id, CASE WHEN tool_name IN ('view', 'click', 'purchase') THEN 'success' ELSE 'error' END AS status, day FROM usage",
)
family.sql(
    "sk15_retention_purge", U, "SELECT day, count(*) AS n FROM {u} WHERE day >= '2024-01-15' GROUP BY day",
    f"WITH {X.USAGE} SELECT day, count(*) AS n FROM usage WHERE day >= '2024-01-15' GROUP BY day",
)

T = {"t": X.tasks}
family.sql(
    "w11_next_task", T, "SELECT task_id, project_id, status, priority FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, priority DESC, created_at, task_id) AS n FROM {t} WHERE status <> 'done') WHERE n = 1",
    f"WITH {X.TASKS} SELECT task_id, project_id, status, priority FROM tasks WHERE status <> 'done' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE status WHEN 'running' THEN 0 ELSE 1 END, priority DESC, created_at, task_id) = 1",
)
family.sql(
    "w12_task_status_report", T,
    "SELECT status, count(*) AS n, min(created_at) AS oldest, count_if(status = 'running' AND created_at <= TIMESTAMP_NTZ '1998-08-02 00:00:00' - INTERVAL 30 MINUTES) AS stuck, array_join(slice(transform(array_sort(collect_list(CASE WHEN rank <= 3 THEN struct(rank, task_id) END)), x -> cast(x.task_id AS string)), 1, 3), ',') AS first_three FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, task_id) AS rank FROM {t}) GROUP BY status",
    f"WITH {X.TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, task_id) AS rank FROM tasks) SELECT status, count(*) AS n, min(created_at) AS oldest, count(*) FILTER (WHERE status = 'running' AND created_at <= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 30 MINUTES) AS stuck, string_agg(CASE WHEN rank <= 3 THEN CAST(task_id AS VARCHAR) END, ',' ORDER BY rank) AS first_three FROM r GROUP BY status",
)
family.sql(
    "st2_active_task_dedup", T, "SELECT min(task_id) AS task_id, concat(cast(project_id AS string), ':', scope) AS dedupe_key, count(*) AS merged FROM {t} WHERE status IN ('queued', 'running') GROUP BY project_id, scope",
    f"WITH {X.TASKS} SELECT min(task_id) AS task_id, project_id || ':' || scope AS dedupe_key, count(*) AS merged FROM tasks WHERE status IN ('queued', 'running') GROUP BY project_id, scope",
)
family.sql(
    "st3_stale_running_requeue", T, "SELECT task_id, CASE WHEN status = 'running' AND created_at < TIMESTAMP_NTZ '1997-01-01 00:00:00' THEN 'queued' ELSE status END AS status FROM {t}",
    f"WITH {X.TASKS} SELECT task_id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '1997-01-01 00:00:00' THEN 'queued' ELSE status END AS status FROM tasks",
)
# Every order as task events: submitted, a day later started (not the queued ones), a day later finished (the done ones).
_TASK_STREAM = f"""{X.TASKS}, e AS (SELECT project_id || ':' || scope AS k, task_id AS t, unnest(range(CASE status WHEN 'queued' THEN 1 WHEN 'running' THEN 2 ELSE 3 END)) AS ev, created_at FROM tasks),
n AS (SELECT k, t, ev, epoch_ms(created_at) + ev * 86400000 AS ms, row_number() OVER (PARTITION BY k ORDER BY created_at + to_days(CAST(ev AS INTEGER)), ev, t) AS n FROM e),
s(k, n, t, ms, action, shown, active, status, started) AS (SELECT k, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM (SELECT DISTINCT k FROM n)
  UNION ALL SELECT s.k, n.n, n.t, n.ms, CASE WHEN ev = 0 THEN CASE WHEN active IS NULL THEN 'queued' ELSE 'reused' END WHEN active = n.t AND ev = 1 AND status = 'queued' THEN 'running' WHEN active = n.t AND ev = 2 THEN 'done' END,
  CASE WHEN ev = 0 THEN coalesce(active, n.t) ELSE n.t END, CASE WHEN ev = 0 THEN coalesce(active, n.t) WHEN ev = 2 AND active = n.t THEN NULL ELSE active END,
  CASE WHEN ev = 0 THEN coalesce(status, 'queued') WHEN ev = 1 AND active = n.t AND status = 'queued' THEN 'running' WHEN ev = 2 AND active = n.t THEN NULL ELSE status END, CASE WHEN ev = 1 AND active = n.t AND status = 'queued' THEN n.ms ELSE started END FROM s JOIN n ON n.k = s.k AND n.n = s.n + 1),
z AS (SELECT k, arg_max_null(active, n) AS t, arg_max_null(status, n) AS status, arg_max_null(started, n) AS started FROM s GROUP BY k)"""


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of task events over the orders file."""
    schema = X.load(spark, sf_dir, "orders").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    n = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    scope = F.when(F.col("o_totalprice") > 100000, "full").otherwise("incremental")
    e = o.select(F.concat_ws(":", F.col("o_custkey").cast("string"), scope).alias("dedupe_key"), F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return e.select("dedupe_key", "task_id", F.element_at(F.array(*map(F.lit, EVENTS)), F.col("k") + 1).alias("event"), (F.col("at") + F.make_dt_interval("k")).alias("at"))


@family.add("stream_st2_active_tasks", f"WITH RECURSIVE {_TASK_STREAM} SELECT k AS dedupe_key, t AS task_id, action, ms AS at_ms, shown AS active_id FROM s WHERE action IS NOT NULL")
def st2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task event decided by the active task of its key, in keyed state."""
    return decided(spark, task_events(spark, sf_dir), "task-stream").filter("action <> 'requeued'")


@family.add("stream_st3_stale_tasks", f"WITH RECURSIVE {_TASK_STREAM} SELECT k AS dedupe_key, t AS task_id, started + 1800000 AS at_ms FROM z WHERE status = 'running' AND started + 1800000 <= (SELECT max(ms) - 600000 FROM n)")
def st3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tasks whose timer fires when the watermark passes half an hour after their start."""
    return decided(spark, task_events(spark, sf_dir), "stale-stream").filter("action = 'requeued'").select("dedupe_key", "task_id", "at_ms")


family.sql(
    "x18_latest_task", T, "SELECT project_id, task_id, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, task_id DESC) AS n FROM {t} WHERE status = 'done') WHERE n = 1",
    f"WITH {X.TASKS} SELECT project_id, task_id, status, created_at FROM tasks WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, task_id DESC) = 1",
)
family.sql(
    "st4_hint_ttl", T, "SELECT task_id, created_at >= TIMESTAMP_NTZ '1998-08-01 00:00:00' - INTERVAL 10 MINUTES AND priority > 2 AS usable FROM {t}",
    f"WITH {X.TASKS} SELECT task_id, created_at >= TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 10 MINUTES AND priority > 2 AS usable FROM tasks",
)
family.sql(
    "w17_order_limit_offset", U, "SELECT event_id, day FROM {u} ORDER BY duration_ms DESC, event_id LIMIT 20 OFFSET 40",
    f"WITH {X.USAGE} SELECT event_id, day FROM usage ORDER BY duration_ms DESC, event_id LIMIT 20 OFFSET 40",
)
family.sql(
    "w1_zero_based_rank", U, "SELECT event_id, row_number() OVER (PARTITION BY project_id ORDER BY duration_ms DESC, event_id) - 1 AS rank FROM {u}",
    f"WITH {X.USAGE} SELECT event_id, row_number() OVER (PARTITION BY project_id ORDER BY duration_ms DESC, event_id) - 1 AS rank FROM usage",
)
_WORST = "max(CASE WHEN k % 13 = 0 THEN 2 WHEN k % 6 = 0 THEN 1 ELSE 0 END)"
family.sql(
    "a30_ops_snapshot_worst_status", U, f"SELECT project_id, element_at(array('ok', 'warning', 'critical'), {_WORST} + 1) AS status, array_join(slice(array_sort(collect_set(CASE WHEN k % 6 = 0 THEN concat('issue-', cast(k % 9 AS string)) END)), 1, 5), ',') AS issues FROM {{u}} GROUP BY project_id",
    f"WITH {X.USAGE} SELECT project_id, (['ok', 'warning', 'critical'])[{_WORST} + 1] AS status, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(CASE WHEN k % 6 = 0 THEN 'issue-' || (k % 9) END))), 1, 5), ','), '') AS issues FROM usage GROUP BY project_id",
)
family.sql(
    "x14_project_issue_tags", U, "SELECT project_id, array_join(array_compact(array(CASE WHEN count_if(status = 'error') > 10 THEN 'errors' END, CASE WHEN avg(duration_ms) > 50 THEN 'slow' END, CASE WHEN count_if(index_state = 'missing') * 3 > count(*) THEN 'unindexed' END)), ',') AS tags FROM {u} GROUP BY project_id",
    f"WITH {X.USAGE} SELECT project_id, coalesce(array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE status = 'error') > 10 THEN 'errors' END, CASE WHEN avg(duration_ms) > 50 THEN 'slow' END, CASE WHEN count(*) FILTER (WHERE index_state = 'missing') * 3 > count(*) THEN 'unindexed' END], lambda x: x IS NOT NULL), ','), '') AS tags FROM usage GROUP BY project_id",
)
