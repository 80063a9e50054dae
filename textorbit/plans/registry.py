"""Registry of named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textorbit.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables of one directory, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def spread(self, name: str) -> DataFrame:
        """A table for CPU-heavy rows, using every core even if it is one small file."""
        return spread(getattr(self, name))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame``; ``sql`` is its independent check."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add
