"""Where the queries of the operators and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def scratch(self, name: str) -> str:
        """A new path in the folder that driver and executors share."""
        return tables.scratch(self.spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table, for plans that read it more than once."""
        return tables.written(df, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register
