"""Query registry: name -> (Spark function, SQL counterpart)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The provided tables of one folder.  A table's schema is read from its files once per application."""

    _schemas: dict[tuple[str, str], T.StructType] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.folder}/{name}.parquet"
        at = (self.spark.sparkContext.applicationId, path)
        if at not in Tables._schemas:
            Tables._schemas[at] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(Tables._schemas[at]).parquet(path)

    @cached_property
    def events_gap(self) -> DataFrame:
        """Events whose value is missing for errors."""
        return self.events.withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            self.sql[name] = sql

    def query(self, name: str, sql: str | None = None):
        def register(build):
            self.add(name, build, sql)
            return build

        return register


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Round for comparison across engines, which add floats in different orders."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})
