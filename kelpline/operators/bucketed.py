"""Tables of which only what changed is written: rows lie in buckets by the hash of a key, one partition folder each.

Replacing the rows of some keys rewrites the buckets that hold these keys and no other; the new buckets are complete in a
staging folder before they take the old ones' place, so a run that is lost before then leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources.store import saved

BUCKET = "bucket"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write df as a table of so many buckets by `key`; a null key has a bucket as well."""
    _bucketed(df, key, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The whole table, with the columns of the schema it was made with."""
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])


def replace(spark: SparkSession, path: str, key: str, buckets: int, changed: DataFrame, rows: DataFrame) -> list[int]:
    """Put `rows` in place of all rows whose key is in changed(key); the buckets that were rewritten.

    A key without new rows is deleted. Keys of `rows` are keys of `changed`. At most `buckets` numbers reach the driver.
    """
    keys = _bucketed(changed.select(key).distinct(), key, buckets)
    touched = sorted(r[0] for r in keys.select(BUCKET).distinct().collect())
    if not touched:
        return []
    schema = _bucketed(rows, key, buckets).schema
    old = spark.read.schema(schema).parquet(path).filter(F.col(BUCKET).isin(touched)).alias("o")
    stay = old.join(keys.select(F.col(key).alias("k")).alias("c"), F.col(f"o.{key}").eqNullSafe(F.col("c.k")), "left_anti")
    staged = saved(stay.select(*schema.names).unionByName(_bucketed(rows, key, buckets)), "staged-buckets")
    empty = [b for b in touched if b not in {r[0] for r in staged.select(BUCKET).distinct().collect()}]
    staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    if empty:  # a bucket that lost its last row
        fs = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for b in empty:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}"), True)
    return touched
