"""Diff sources: unified diffs to changed lines, name-status lists to changed files, process lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CODE = ("ts", "tsx", "js", "jsx", "py", "go", "rs", "java", "cpp", "c", "h", "cs", "en", "de", "fr", "es")


def changed_lines(lines: DataFrame) -> DataFrame:
    """(diff_id, n, line) of unified diffs -> (diff_id, file_path, line): new-side lines of every hunk.

    A hunk belongs to the last `+++` header before it; `/dev/null` and pure deletions give nothing.
    """
    w = Window.partitionBy("diff_id").orderBy("n")
    header = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.substring("line", 5, 1 << 20), "^b/", ""))
    r = lines.withColumn("file_path", F.last(header, True).over(w))
    m = r.filter(F.col("line").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@")).filter("file_path <> '/dev/null'")
    start = F.regexp_extract("line", r"\+(\d+)", 1).cast("int")
    count = F.regexp_extract("line", r"\+\d+,(\d+)", 1)
    n = F.when(count == "", 1).otherwise(F.try_to_number(count, F.lit("999999999")).cast("int"))
    m = m.select("diff_id", "file_path", start.alias("start"), n.alias("count")).filter("count > 0")
    return m.select("diff_id", "file_path", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line"))


def changed_files(lines: DataFrame, code: tuple[str, ...] = CODE) -> DataFrame:
    """(line) of `git diff --name-status` -> (status, path, old_path) of code files."""
    p = lines.select(F.split("line", "\t").alias("p"))
    letter = F.substring(F.element_at("p", 1), 1, 1)
    status = F.when(letter == "A", "added").when(letter == "M", "modified").when(letter == "D", "deleted").when(letter.isin("R", "C"), "renamed")
    r = p.select(status.alias("status"), F.element_at("p", -1).alias("path"), F.when(letter == "R", F.try_element_at("p", F.lit(2))).alias("old_path"))
    return r.filter(F.col("status").isNotNull() & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*code))


def processes(lines: DataFrame) -> DataFrame:
    """(line) of `ps` as pid, elapsed, command -> pid, elapsed_s, command; other lines are dropped."""
    pattern = r"^\s*(\d+)\s+(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)\s+(.*)$"
    g = [F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", pattern, i), F.lit("")), F.lit("999999")).cast("long"), F.lit(0)) for i in range(2, 6)]
    r = lines.filter(F.col("line").rlike(pattern))
    return r.select(F.regexp_extract("line", pattern, 1).cast("long").alias("pid"), (g[0] * 86400 + g[1] * 3600 + g[2] * 60 + g[3]).alias("elapsed_s"), F.regexp_extract("line", pattern, 6).alias("command"))


def duplicate_processes(ps: DataFrame) -> DataFrame:
    """All but the youngest process of a command (the largest pid where ages are equal)."""
    w = Window.partitionBy("command").orderBy("elapsed_s", F.col("pid").desc())
    return ps.withColumn("n", F.row_number().over(w)).filter("n > 1").drop("n")
