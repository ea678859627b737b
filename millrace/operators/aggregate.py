"""Grouped aggregates, time cells, defect rates, Pareto and co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import epoch_us
from millrace.operators.quantiles import modes, quantiles

PLAIN = {
    "max": F.max,
    "min": F.min,
    "mean": F.avg,
    "std": F.stddev_samp,
    "count": F.count,
    "range": lambda c: F.max(c) - F.min(c),
}
SHAPED = {"median": [0.5], "iqr": [0.25, 0.75]}


def aggregate(df: DataFrame, col: str, function: str, keys: Sequence[str], out: str, time: str | None = None) -> DataFrame:
    """One aggregate per group: max min mean std range median iqr count first last mode ratio."""
    known = df.where(F.col(col).isNotNull())
    if function in PLAIN:
        return known.groupBy(*keys).agg(PLAIN[function](col).alias(out))
    if function in SHAPED:
        probs = SHAPED[function]
        names = [f"_q{i}" for i in range(len(probs))]
        found = quantiles(known, [col], probs, keys, names=names)
        value = F.col("_q1") - F.col("_q0") if function == "iqr" else F.col("_q0")
        return found.select(*keys, value.alias(out))
    if function in ("first", "last"):
        pick = F.min_by if function == "first" else F.max_by
        return known.groupBy(*keys).agg(pick(col, time).alias(out))
    if function == "mode":
        return modes(known, col, keys, out)
    if function == "ratio":
        total = known.count()
        return known.groupBy(*keys).agg((F.count(col) * F.lit(100.0) / F.lit(float(max(total, 1)))).alias(out))
    raise ValueError(f"unknown aggregate {function!r}")


def aggregate_plot(
    df: DataFrame, col: str, function: str, facets: Sequence[str] = (), color: str | None = None, division: str | None = None, out: str = "agg"
) -> DataFrame:
    """Aggregate by facets, colour and division; rows without a group value are left out."""
    keys = [k for k in [*facets, color, division] if k]
    return aggregate(df.dropna(subset=keys) if keys else df, col, function, keys, out)


def time_cell(time: Column, step_minutes: float, zone: str = "UTC") -> Column:
    """Start of the local-time cell a record falls into."""
    local = F.from_utc_timestamp(time, zone)
    day = F.date_trunc("day", local)
    width = int(step_minutes * 60_000_000)
    into = epoch_us(local) - epoch_us(day)
    return F.timestamp_micros(epoch_us(day) + F.floor(into / F.lit(width)).cast("long") * F.lit(width))


def rate(count: Column, function: str, step_minutes: float) -> Column:
    """Counts of a time cell as count_per_hour, count_per_min or time_per_count (seconds)."""
    if function == "count_per_hour":
        return count / F.lit(step_minutes / 60.0)
    if function == "count_per_min":
        return count / F.lit(float(step_minutes))
    return F.try_divide(F.lit(step_minutes * 60.0), count)


RATES = ("count_per_hour", "count_per_min", "time_per_count")


def time_cells(df: DataFrame, time: str, col: str, function: str, step_minutes: float, zone: str = "UTC", keys: Sequence[str] = (), out: str = "agg") -> DataFrame:
    """Aggregate or rate per time cell."""
    celled = df.withColumn("cell", time_cell(F.col(time), step_minutes, zone))
    groups = [*keys, "cell"]
    if function in RATES:
        counts = celled.groupBy(*groups).agg(F.count(col).alias("_n"))
        return counts.select(*groups, rate(F.col("_n"), function, step_minutes).alias(out))
    return aggregate(celled, col, function, groups, out, time)


def calendar_heatmap(df: DataFrame, time: str, col: str, function: str, start: datetime, end: datetime, step_minutes: int, zone: str = "UTC", out: str = "agg") -> DataFrame:
    """Every cell of [start, end) with its aggregate, empty cells included."""
    spark = df.sparkSession
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    local = F.from_utc_timestamp(F.col(time), zone)
    found = time_cells(df.where((local >= lo) & (local < hi)), time, col, function, step_minutes, zone, out=out)
    step = F.expr(f"interval {int(step_minutes)} minutes")
    grid = spark.range(1).select(F.explode(F.sequence(lo, F.lit(end - timedelta(minutes=step_minutes)).cast("timestamp"), step)).alias("cell"))
    return grid.join(found, "cell", "left")


def xy_heatmap(df: DataFrame, x: str, y: str, color: str, function: str, out: str = "agg") -> DataFrame:
    """Colour aggregate per (x, y) label pair; ``ratio`` is the share of all rows in percent."""
    return aggregate(df.dropna(subset=[x, y]), color, function, [x, y], out)


OPERATORS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
}


def ng_rate(df: DataFrame, judge: str, operator: str, value, keys: Sequence[str] = (), out: str = "ng_rate") -> DataFrame:
    """Percent of known judgements that fulfil the defect condition, per group."""
    hit = OPERATORS[operator](F.col(judge), F.lit(value))
    return df.groupBy(*keys).agg((F.count_if(hit) * 100.0 / F.nullif(F.count(judge), F.lit(0))).alias(out))


def ng_rate_by_terms(df: DataFrame, time: str, judge: str, operator: str, value, terms: Sequence[tuple[datetime, datetime]], out: str = "ng_rate") -> DataFrame:
    """Defect rate per term; here terms include their end and exclude their start."""
    hit = OPERATORS[operator](F.col(judge), F.lit(value))
    cells = []
    for i, (lo, hi) in enumerate(terms):
        inside = (F.col(time) > F.lit(lo).cast("timestamp")) & (F.col(time) <= F.lit(hi).cast("timestamp"))
        known = F.count_if(inside & F.col(judge).isNotNull())
        rate_col = F.count_if(inside & hit) * 100.0 / F.nullif(known, F.lit(0))
        cells.append(F.struct(F.lit(i).alias("term"), known.alias("n"), rate_col.alias(out)))
    wide = df.agg(*[c.alias(f"t{i}") for i, c in enumerate(cells)])
    return wide.select(F.explode(F.array(*wide.columns)).alias("t")).select("t.*")


def hourly_counts(df: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", F.col(time)).alias("hour")).agg(F.count("*").alias("n"))


# Counter grain shown for each display level: a day in hours, a month in days, a year in months.
GRAINS = {"day": "hour", "month": "day", "year": "month"}


def count_calendar(counts: DataFrame, start: datetime, end: datetime, level: str, zone: str = "UTC") -> DataFrame:
    """Record counts on a zero-filled grid, from (hour, n) counters."""
    grain = GRAINS[level]
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    local = F.from_utc_timestamp("hour", zone)
    found = counts.where((local >= lo) & (local < hi)).groupBy(F.date_trunc(grain, local).alias("slot")).agg(F.sum("n").alias("n"))
    step = F.expr(f"interval 1 {grain}")
    last = F.date_trunc(grain, hi - F.expr("interval 1 microsecond"))
    grid = counts.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc(grain, lo), last, step)).alias("slot"))
    return grid.join(found, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


def pareto(df: DataFrame, cols: Sequence[str], highlight: float = 0.8) -> DataFrame:
    """Totals of count columns, largest first, with cumulative ratio; one row per column."""
    totals = df.agg(*[F.sum(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "name", "total")
    upto = Window.orderBy(F.desc("total"), F.asc("name"))  # as many rows as the frame has columns
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = F.sum("total").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    ranked = totals.withColumn("ratio", running / F.sum("total").over(whole))
    return ranked.withColumn("highlight", F.col("ratio") <= highlight)


def bucket_sums(df: DataFrame, time: str, cols: Sequence[str], unit: str) -> DataFrame:
    """Count columns summed per hour or day."""
    return df.groupBy(F.date_trunc(unit, F.col(time)).alias("bucket")).agg(*[F.sum(c).cast("double").alias(c) for c in cols])


def co_occurrence(df: DataFrame, time: str, cols: Sequence[str], unit: str = "hour") -> DataFrame:
    """(source, target, weight): sum over time buckets of the smaller of two counts.

    Pairs are of columns, so all weights come from one aggregate over the bucket rows.
    """
    sums = bucket_sums(df, time, cols, unit)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    wide = sums.agg(
        *[F.sum(F.least(F.coalesce(F.col(a), F.lit(0.0)), F.coalesce(F.col(b), F.lit(0.0)))).alias(f"w{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(f"w{i}").alias("weight")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*cells)).alias("e")).select("e.*")


def node_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "name", "size")


def strongest_edges(edges: DataFrame, percent: float) -> DataFrame:
    """The heaviest ``percent`` of the edges."""
    keep = round(percent * edges.count() / 100)
    return edges.orderBy(F.desc("weight"), F.asc("source"), F.asc("target")).limit(keep)


def invalid_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, errors): values that are not non-negative integers."""
    bad = []
    for c in cols:
        v = F.col(c).cast("string").try_cast("double")
        bad.append(F.count_if(F.col(c).isNull() | v.isNull() | (v < 0) | (F.floor(v) != v)).alias(c))
    return df.agg(*bad).unpivot([], list(cols), "column", "errors")


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n) distinct values per column."""
    return df.agg(*[F.count_distinct(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "n")


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most common labels with counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(k)


def keep_most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.join(most_common(df, col, k).select(col), col, "left_semi")


