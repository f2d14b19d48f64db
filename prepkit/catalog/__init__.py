"""Registered queries: each reads the given tables and has, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


class Registry:
    """Collects queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the function under its own name."""

        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return register


def all_registries() -> list[Registry]:
    """Every group of queries."""
    from prepkit.catalog import jobs, relational, scenarios, shaping, storage, texts

    return [module.registry for module in (storage, shaping, relational, texts, scenarios, jobs)]
