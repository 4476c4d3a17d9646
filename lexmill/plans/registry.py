"""Registration of queries beside the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of one data folder, read when asked for; rows delivered twice count once in the narrow views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def once(self, name: str, *columns: str) -> DataFrame:
        """Distinct rows of some columns, the key among them."""
        return table(self.spark, self.sf_dir, name).select(*columns).distinct()


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
