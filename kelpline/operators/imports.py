"""Import resolution: candidate paths in order of preference, joined with the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")


def join_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, with . and .. resolved."""
    parts = F.filter(F.concat(F.split(folder, "/"), F.split(relative, "/")), lambda p: (p != "") & (p != "."))
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p)))
    return F.array_join(keep, "/")


def candidates(language: Column, folder: Column, name: Column) -> Column:
    """Paths that an import may mean, best first: JS/TS relative files and indexes, Python modules, Go and Java folders."""
    base = join_path(folder, name)
    has = F.regexp_like(name, F.lit(r"\.(?:ts|tsx|js|jsx)$"))
    bare = F.regexp_replace(base, r"\.(?:ts|tsx|js|jsx)$", "")
    js = F.when(~F.startswith(name, F.lit(".")), F.array().cast("array<string>")).when(has, F.array(*[F.concat(bare, F.lit(e)) for e in EXTENSIONS])).otherwise(F.array(*[F.concat(base, F.lit(e)) for e in EXTENSIONS], *[F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS]))
    dotted = F.regexp_replace(name, r"\.", "/")
    py = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))
    java = F.array(F.concat(dotted, F.lit(".java")))
    return F.when(language.isin("typescript", "javascript"), js).when(language == "python", py).when(language == "java", java).otherwise(F.array().cast("array<string>"))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, language, folder, name) x files(path) -> import_id, target: the best candidate that exists.

    JS and TS candidates are whole paths; Python's and Java's may lie under any root, the one nearest to the importing
    folder being taken (most leading folders in common, then the shortest, then by name).
    """
    c = imports.select("import_id", "language", "folder", F.posexplode(candidates(F.col("language"), F.col("folder"), F.col("name"))).alias("order", "want"))
    exact = c.join(files.select(F.col("path").alias("want")), "want").select("import_id", "order", F.lit(1 << 20).alias("common"), F.col("want").alias("path"))
    last = F.element_at(F.split("want", "/"), -1)
    loose = c.filter(F.col("language").isin("python", "java")).withColumn("file", last)
    f = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    loose = loose.join(f, "file").filter(F.col("path").endswith(F.concat(F.lit("/"), F.col("want"))))
    a, b = F.split("folder", "/"), F.split("path", "/")
    common = F.size(F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    both = exact.union(loose.select("import_id", "order", common.alias("common"), "path"))
    w = Window.partitionBy("import_id").orderBy("order", F.col("common").desc(), F.length("path"), "path")
    return both.withColumn("n", F.row_number().over(w)).filter("n = 1").select("import_id", F.col("path").alias("target"))
