"""Collects a family's queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Family:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return put

    def sql(self, name: str, views: dict[str, Query], spark_sql: str, oracle: str) -> None:
        """A query that is Spark SQL over named views."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_sql, **{k: v(spark, sf_dir) for k, v in views.items()})

        self.queries[name] = query
        self.oracles[name] = oracle
