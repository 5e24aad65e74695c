"""Aggregates over usage and retrieval telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.text import js_round, ratio


def rate(predicate: Column, digits: int = 4) -> Column:
    """Share of rows that satisfy a predicate; 0 without rows, null counting as not satisfied."""
    return js_round(F.coalesce(F.avg(F.when(predicate, 1.0).otherwise(0.0)), F.lit(0.0)), digits)


def percentile(values: Column, p: float) -> Column:
    """Nearest-rank percentile, 0 without rows; the same rank rule as PERCENTILE_DISC."""
    ordered = F.array_sort(F.collect_list(values))
    place = F.greatest(F.ceil(F.size(ordered) * F.lit(p)).cast("int"), F.lit(1))
    return F.coalesce(F.try_element_at(ordered, place), F.lit(0.0))


def percentiles_by(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles by group without gathering it: sorted and numbered within partitions of the group key."""
    w = Window.partitionBy(*by)
    r = df.withColumn("n", F.row_number().over(w.orderBy(value))).withColumn("m", F.count("*").over(w))
    at = {name: F.max(F.when(F.col("n") == F.greatest(F.ceil(F.col("m") * p), F.lit(1)), F.col(value))) for name, p in ps.items()}
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *[c.alias(k) for k, c in at.items()])


def daily(usage: DataFrame) -> DataFrame:
    """One row a day: calls, mean duration, error rate, share of calls that found no index."""
    return usage.groupBy("day").agg(
        F.count("*").alias("calls"), js_round(F.avg("duration_ms"), 2).alias("avg_ms"), rate(F.col("status") == "error").alias("error_rate"), rate(F.col("index_state") == "missing").alias("missing_rate")
    )


def latest_days(usage: DataFrame, n: int) -> DataFrame:
    """Rows of the n latest different days that occur."""
    days = usage.select("day").distinct().orderBy(F.col("day").desc()).limit(n)
    return usage.join(days, "day", "left_semi")


def hours_back(usage: DataFrame, hours: int) -> DataFrame:
    """Rows of the last hours before the newest row."""
    newest = usage.agg(F.max("ts").alias("newest"))
    return usage.join(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {hours} HOURS")).drop("newest")


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, metric, operator, threshold, severity, enabled) x metrics (project, metric, value) -> fired alerts.

    A metric that a project doesn't have counts as 0.
    """
    projects = metrics.select("project").distinct()
    grid = projects.join(F.broadcast(rules.filter("enabled"))).join(metrics, ["project", "metric"], "left")
    v, t = F.coalesce("value", F.lit(0.0)), F.col("threshold")
    fires = F.expr("CASE operator WHEN '>' THEN v > t WHEN '>=' THEN v >= t WHEN '<' THEN v < t WHEN '<=' THEN v <= t WHEN '==' THEN v = t ELSE false END")
    return grid.withColumn("v", v).withColumn("t", t).filter(fires).select("project", "rule_id", "severity", F.col("v").alias("value"), "threshold")


def repo_score(success: Column, empty: Column, stale: Column, failed: Column) -> Column:
    return js_round((success * 0.35 + (1 - empty) * 0.25 + (1 - stale) * 0.2 + (1 - failed) * 0.2) * 100, 1)


def module_score(verified: Column, stale: Column, corrected: Column) -> Column:
    return js_round((F.when(verified, 1.0).otherwise(0.4) * 0.45 + (1 - stale) * 0.3 + (1 - corrected) * 0.25) * 100, 1)


def band(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 60, "watch").otherwise("risky")


def health_score(stale: Column, expired: Column, orphaned: Column, catalog_ok: Column, empty: Column) -> Column:
    """100 less what each failing test costs, 0 at least."""
    cost = F.when(stale > 0.3, 20).otherwise(0) + F.when(expired > 0.1, 15).otherwise(0) + F.when(orphaned > 0.2, 15).otherwise(0)
    cost = cost + F.when(~catalog_ok, 10).otherwise(0) + F.when(empty > 0, 5).otherwise(0)
    return F.greatest(F.lit(0), 100 - cost)


def share(part: Column, whole: Column) -> Column:
    return js_round(ratio(part, whole), 4)
