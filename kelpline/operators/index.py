"""Incremental index maintenance: classification of scanned files, deltas, upserts, snapshots, update plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 512 * 1024


def classify(scanned: DataFrame, known: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """scanned(path, hash, size, mtime, content, language) against known(path, hash, size, mtime) -> path, status.

    skipped: too large, or a NUL byte; unchanged: same time and size, or same hash; skipped: lock and vendored JSON;
    else added or modified.
    """
    k = known.select("path", F.col("hash").alias("known_hash"), F.col("size").alias("known_size"), F.col("mtime").alias("known_mtime"))
    r = scanned.join(k, "path", "left")
    vendored = (F.col("language") == "json") & (F.col("path").endswith("-lock.json") | F.contains("path", F.lit("node_modules/")))
    status = (
        F.when(F.col("size") > max_bytes, "skipped")
        .when(F.col("known_mtime").eqNullSafe(F.col("mtime")) & F.col("known_size").eqNullSafe(F.col("size")) & F.col("known_hash").isNotNull(), "unchanged")
        .when(F.contains(F.coalesce("content", F.lit("")), F.lit("\0")), "skipped")
        .when(F.col("known_hash") == F.col("hash"), "unchanged")
        .when(vendored, "skipped")
        .when(F.col("known_hash").isNull(), "added")
        .otherwise("modified")
    )
    return r.select("path", "size", status.alias("status"))


def deleted(scanned: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(scanned.select("path"), "path", "left_anti")


def healing(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Known files still there whose vectors don't belong to their current hash."""
    return known.filter(~F.col("vector_index_hash").eqNullSafe(F.col("hash"))).join(scanned.select("path"), "path", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: list[str], content: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of new replace those of old with the same key; contents above max_bytes become null."""
    if content:
        new = new.withColumn(content, F.when(F.octet_length(content) <= max_bytes, F.col(content)))
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def newest_version(rows: DataFrame, key: list[str], version: list) -> DataFrame:
    """The rows of each key's newest version."""
    w = Window.partitionBy(*key).orderBy(*version)
    return rows.withColumn("__n", F.dense_rank().over(w)).filter("__n = 1").drop("__n")


def cascade_delete(gone: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def signals(changed: Column, total: Column, incremental: Column, full: Column, churn: float = 0.35, cost: float = 0.65, min_files: int = 8, min_changed: int = 5) -> dict[str, Column]:
    """Churn and cost ratios and which of them ask for a full rebuild; few files or few changes never do."""
    full = F.greatest(full, incremental, F.lit(0))
    ratio = F.when(total > 0, changed / total).otherwise(0.0)
    price = F.when(full > 0, incremental / full).otherwise(0.0)
    able = (total >= min_files) & (changed >= min_changed)
    return {"churn_ratio": ratio, "cost_ratio": price, "eligible": able, "high_churn": able & (ratio >= churn), "cost_high": able & (price >= cost)}


def plan(statuses: DataFrame, gone: DataFrame, heal: DataFrame, full_bytes: DataFrame) -> DataFrame:
    """One row: counts of the change, its signals, and mode none, incremental or full."""
    s = statuses.agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("added", "modified", "unchanged", "skipped")], F.coalesce(F.sum(F.when(F.col("status").isin("added", "modified"), F.col("size"))), F.lit(0)).alias("b1"), F.count("*").alias("total"))
    g = gone.agg(F.count("*").alias("deleted"), F.coalesce(F.sum("size"), F.lit(0)).alias("b2"))
    h = heal.agg(F.count("*").alias("healing"), F.coalesce(F.sum("size"), F.lit(0)).alias("b3"))
    one = s.join(F.broadcast(g)).join(F.broadcast(h)).join(F.broadcast(full_bytes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("full"))))
    changed = F.col("added") + F.col("modified") + F.col("deleted") + F.col("healing")
    x = signals(changed, F.col("total"), F.col("b1") + F.col("b2") + F.col("b3"), F.col("full"))
    mode = F.when(x["high_churn"] | x["cost_high"], "full").when(changed > 0, "incremental").otherwise("none")
    return one.select("added", "modified", "unchanged", "skipped", "deleted", "healing", F.round(x["churn_ratio"], 6).alias("churn_ratio"), F.round(x["cost_ratio"], 6).alias("cost_ratio"), mode.alias("mode"))


def retained(snapshots: DataFrame, keep: int, current: Column) -> DataFrame:
    """Snapshots to keep: the `keep` newest of a project and the current one."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("mtime").desc(), "snapshot_id"))
    return snapshots.withColumn("__n", n).filter((F.col("__n") <= keep) | current).drop("__n")


class SnapshotStore:
    """Versioned Parquet directories with a pointer; a reader sees the old or the new snapshot, nothing between.

    Works through Hadoop's file system, so any store Spark can write will do; the pointer is replaced by a rename.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def write(self, name: str, tables: dict[str, DataFrame]) -> None:
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/snapshots/{name}/{table}")

    def commit(self, name: str, expect: dict[str, int] | None = None) -> None:
        """Check row counts, then point readers to the snapshot."""
        for table, n in (expect or {}).items():
            found = self.read(table, name).count()
            if found != n:
                raise ValueError(f"snapshot {name}: {table} has {found} rows, not {n}")
        out = self._fs.create(self._path("current.next"), True)
        out.write(bytearray(name.encode()))
        out.close()
        self._fs.delete(self._path("current"), False)
        self._fs.rename(self._path("current.next"), self._path("current"))

    def current(self) -> str | None:
        for p in ("current", "current.next"):  # a crash between delete and rename leaves the latter
            if self._fs.exists(self._path(p)):
                return self.spark.read.text(f"{self.root}/{p}").first()[0]
        return None

    def read(self, table: str, name: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshots/{name or self.current()}/{table}")

    def prune(self, keep: int = 5) -> list[str]:
        """Delete all but the newest `keep` and the current one; the names that went."""
        found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(self._path("snapshots"))), reverse=True)
        gone = [n for _, n in found[keep:] if n != self.current()]
        for n in gone:
            self._fs.delete(self._path(f"snapshots/{n}"), True)
        return gone
