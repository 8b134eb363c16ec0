"""Registration of queries next to their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


class Tables:
    """Tables of one scale factor, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Book:
    """`queries` and `oracle` of a plan module; functions take (spark, Tables)."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def register(f: Callable[[SparkSession, Tables], DataFrame]):
            name = f.__name__

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(spark, Tables(spark, sf_dir))

            self.queries[name] = run
            if sql is not None:
                self.oracle[name] = sql
            return f

        return register
