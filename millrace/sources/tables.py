"""Database and partitioned table sources: options, incremental windows, browsing, source joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# JDBC drivers by kind of database.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "oracle": "oracle.jdbc.OracleDriver",
    "sqlite": "org.sqlite.JDBC",
}


def jdbc_options(kind: str, url: str, table: str, partition: tuple[str, str, str, int] | None = None, fetch: int = 10_000) -> dict[str, str]:
    """Reader options; ``partition`` is (column, lower, upper, tasks) for a parallel read."""
    options = {"driver": DRIVERS[kind], "url": url, "dbtable": table, "fetchsize": str(fetch)}
    if partition:
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        options.update(dict(zip(names, map(str, partition))))
    return options


def read_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def time_ranges(start: datetime, end: datetime, hours: float = 24) -> list[tuple[datetime, datetime]]:
    out = []
    while start < end:
        out.append((start, min(start + timedelta(hours=hours), end)))
        start = out[-1][1]
    return out


def range_predicates(column: str, ranges: Sequence[tuple[datetime, datetime]]) -> list[str]:
    """One JDBC predicate, hence one task, per time range."""
    return [f"{column} >= '{lo:%Y-%m-%d %H:%M:%S}' AND {column} < '{hi:%Y-%m-%d %H:%M:%S}'" for lo, hi in ranges]


def pull_window(mode: str, oldest: datetime | None, newest: datetime | None, now: datetime, span: timedelta = timedelta(hours=12)) -> tuple[datetime, datetime]:
    """Next window: ``future`` on from the newest stored record, ``past`` back from the oldest one."""
    if mode == "future":
        start = newest or now - span
        return start, min(start + span, now)
    end = oldest or now
    return end - span, end


def next_span(span: timedelta, rows: int, limit: int) -> timedelta:
    """Halve a window that was too full, double one that was nearly empty, between one hour and 16 days."""
    if rows >= limit:
        span = span / 2
    elif rows < limit / 4:
        span = span * 2
    return min(max(span, timedelta(hours=1)), timedelta(days=16))


def pull(df: DataFrame, time: str, window: tuple[datetime, datetime]) -> DataFrame:
    lo, hi = window
    return df.where((F.col(time) >= F.lit(lo).cast("timestamp")) & (F.col(time) < F.lit(hi).cast("timestamp")))


def newer_than(df: DataFrame, id_col: str, mark: int) -> DataFrame:
    """Rows after a stored high-water mark."""
    return df.where(F.col(id_col) > F.lit(mark))


def distinct_in_ranges(df: DataFrame, time: str, ranges: Sequence[tuple[datetime, datetime]]) -> DataFrame:
    """Distinct rows of several ranges, in a single scan."""
    tests = [(F.col(time) >= F.lit(lo).cast("timestamp")) & (F.col(time) < F.lit(hi).cast("timestamp")) for lo, hi in ranges]
    return df.where(reduce(lambda a, b: a | b, tests)).distinct()


def shards_in(shards: Mapping[str, tuple[datetime, datetime]], start: datetime, end: datetime) -> list[str]:
    """Names of monthly source tables whose time span meets [start, end)."""
    return sorted(n for n, (lo, hi) in shards.items() if lo < end and hi >= start)


def union_shards(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def browse(df: DataFrame, column: str | None, descending: bool, limit: int) -> DataFrame:
    """One page of a table."""
    if column is None:
        return df.limit(limit)
    return df.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)).limit(limit)


def measurement_records(measures: DataFrame, events: DataFrame, equips: DataFrame, lines: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Long records of an entity-attribute-value source: values with their event, equipment and line.

    Events grow with the measures, so a task hashes its share of them only: they are not broadcast, however small Spark
    takes them to be, and the measures, which are many more, are not sorted.
    """
    out = measures.join(events.hint("shuffle_hash"), on["event"]).join(equips, on["equip"])
    return out.join(lines, on["line"])
