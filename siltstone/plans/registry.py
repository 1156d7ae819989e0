"""Registry of named queries with the SQL that states their result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.files import table

#: Fixed 'now' of the queries that ask for one: 2026-03-01 and, for the event stream, 2024-01-31, both UTC.
NOW = 1_772_323_200_000
EVENTS_NOW = 1_706_659_200_000
TODAY = "2026-03-01"


class Tables:
    """Tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of :class:`Tables` under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
