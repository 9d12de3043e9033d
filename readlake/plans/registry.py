"""Names of queries, their functions and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}
        registry = self

        class Add:
            def __call__(self, name: str, query: Query, sql: str | None) -> None:
                if name in registry.queries:
                    raise ValueError(f"query {name} is registered twice")
                registry.queries[name] = query
                if sql:
                    registry.oracle[name] = sql

            def query(self, name: str, sql: str | None) -> Callable[[Query], Query]:
                def register(function: Query) -> Query:
                    self(name, function, sql)
                    return function

                return register

        self.add = Add()
