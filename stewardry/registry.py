"""Registry of runnable queries, and of user checks, generators and transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stewardry.scale import spread


class Tables:
    """Lazy access to the parquet tables of one folder: ``tables.orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table for work that is heavy per row, on all cores even from one file."""
        return spread(self.spark.read.parquet(self.path(name)).select(*columns))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    headline: bool

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, headline: bool = False):
    """Register ``fn(tables) -> DataFrame`` together with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = Query(name, fn, sql, headline)
        return fn

    return register
