"""Typing, validation and repair of whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import repair
from millrace.functions.numeric import is_finite, is_inf
from millrace.functions.timefmt import parse_time
from millrace.operators import ordering

RANGES = {"SMALL_INT": (-(2**15), 2**15 - 1), "INTEGER": (-(2**31), 2**31 - 1), "BIG_INT": (-(2**63), 2**63 - 1)}
TYPE_NAMES = {"SMALL_INT": "smallint", "INTEGER": "int", "BIG_INT": "bigint", "REAL": "double", "BOOLEAN": "boolean",
              "DATETIME": "timestamp", "TEXT": "string", "CATEGORY": "string"}


def typed(name: str, kind: str, na_texts: Sequence[str] = ()):
    """A text column read as one of the data types; unreadable or out-of-range values are NULL."""
    raw = F.col(name).cast("string")
    raw = F.when(~raw.isin(list(na_texts)), raw) if na_texts else raw
    if kind in ("TEXT", "CATEGORY"):
        return raw
    if kind == "DATETIME":
        return raw.try_cast("timestamp")
    if kind == "BOOLEAN":
        bit = F.when(raw == "true", F.lit(1.0)).when(raw == "false", F.lit(0.0)).otherwise(repair.read_number(raw))
        return F.when(bit.isin(0.0, 1.0), bit == 1.0)
    if kind == "BIG_INT":
        return F.when(raw.rlike(r"^\d+$"), raw.try_cast("bigint"))
    number = repair.read_number(raw)
    if kind == "REAL":
        return number
    lo, hi = RANGES[kind]
    whole = (F.floor(number) == number) & number.between(lo, hi)
    return F.when(whole, number).try_cast(TYPE_NAMES[kind])


def cast_and_reject(df: DataFrame, types: Mapping[str, str], na_texts: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): a row is rejected only when all its data columns are NULL after the cast."""
    cast = df.withColumns({c: typed(c, k, na_texts) for c, k in types.items()})
    empty = F.coalesce(*[F.col(c).cast("string") for c in types]).isNull()
    return cast.where(~empty), cast.where(empty)


def validate(df: DataFrame, types: Mapping[str, str], na_texts: Sequence[str] | None = None, flag: str = "is_error") -> DataFrame:
    """Columns read as INTEGER, REAL or TEXT with NA and infinity words; ``flag`` marks rows that failed anywhere."""
    na = list(repair.NA_TEXTS if na_texts is None else na_texts)
    out, bad = {}, F.lit(False)
    for name, kind in types.items():
        field = df.schema[name].dataType
        if isinstance(field, T.StringType) and kind in ("INTEGER", "REAL"):
            number, error = repair.number_text(F.col(name), na)
            bad = bad | F.coalesce(error, F.lit(False))
            if kind == "INTEGER":
                number = F.when(is_finite(number), number)
                lo, hi = RANGES["INTEGER"]
                bad = bad | F.coalesce(~number.between(lo, hi), F.lit(False))
                number = F.when(number.between(lo, hi), number).try_cast("int")
            out[name] = number
        elif isinstance(field, T.StringType):
            text = repair.strip_quotes(F.col(name))
            out[name] = F.when(~text.isin(na + repair.INF_TEXTS + repair.NEG_INF_TEXTS), text)
        elif kind == "INTEGER" and isinstance(field, (T.DoubleType, T.FloatType)):
            out[name] = F.when(is_finite(F.col(name)), F.col(name)).try_cast("bigint")
        elif kind == "INTEGER" and isinstance(field, T.LongType):
            lo, hi = RANGES["INTEGER"]
            bad = bad | F.coalesce(~F.col(name).between(lo, hi), F.lit(False))
            out[name] = F.when(F.col(name).between(lo, hi), F.col(name))
    return df.select("*", bad.alias(flag)).withColumns(out)


def split_missing(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a value, rows without): records without event time go to the error set."""
    return df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())


def parse_datetime(df: DataFrame, col: str, null_is_error: bool = True, flag: str = "is_error") -> DataFrame:
    """Quotes stripped and parsed; ``flag`` marks texts that are not a time (and NULLs if asked)."""
    parsed = repair.strip_quotes(F.col(col).cast("string")).try_cast("timestamp")
    bad = parsed.isNull() if null_is_error else parsed.isNull() & F.col(col).isNotNull()
    return df.select("*", bad.alias(flag)).withColumn(col, parsed)


def to_utc(df: DataFrame, col: str, zone: str) -> DataFrame:
    return df.withColumn(col, F.to_utc_timestamp(F.col(col), zone))


def to_local(df: DataFrame, col: str, zone: str) -> DataFrame:
    return df.withColumn(col, F.from_utc_timestamp(F.col(col), zone))


def convert_datetime_formats(df: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """Text columns parsed with the user's strftime format."""
    return df.withColumns({c: parse_time(F.col(c), f) for c, f in formats.items()})


def event_time(df: DataFrame, date: str, time: str, out: str, zone: str = "UTC") -> DataFrame:
    """Event time from main date and main time columns, local to ``zone``."""
    parsed = repair.date_time_text(repair.repair_date(F.col(date)), repair.repair_time(F.col(time)))
    return df.withColumn(out, F.to_utc_timestamp(parsed, zone))


def dummy_time(df: DataFrame, order: ordering.Order, last_stored: datetime | None, today: datetime, out: str = "event_time") -> DataFrame:
    """Event times 10 s apart in file order, from one day after the last stored time or from this month's start."""
    start = F.lit(last_stored).cast("timestamp") + F.expr("interval 1 day") if last_stored else F.lit(
        today.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    ).cast("timestamp")
    numbered = ordering.row_numbers(df, order, out="_rn")
    us = F.unix_micros(start) + (F.col("_rn") - 1) * F.lit(10_000_000)
    return numbered.withColumn(out, F.timestamp_micros(us)).drop("_rn")


def replace_sentinels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """9999, 99.999, repeated digits, dashes: integers and texts become NULL, reals an infinity."""
    return df.withColumns({c: repair.without_sentinels(c, df.schema[c].dataType) for c in cols})


def abnormal_counts(df: DataFrame, col: str, top: int | None = None, threshold: float = 50, min_distinct: int = 1) -> DataFrame:
    """Values that occur far more often than both neighbouring values, over all rows.

    ``min_distinct`` asks for so many values at least, ``top`` keeps the most extreme ones.
    """
    counts = df.where(is_finite(F.col(col).cast("double"))).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    if counts.limit(min_distinct).count() < min_distinct:
        return counts.limit(0).withColumn("ratio", F.lit(0.0))
    left = ordering.shift(counts, "n", 1, ["value"], default=0, out="_before")
    both = ordering.shift(left, "n", -1, ["value"], default=0, out="_after")
    ratio = (F.col("n") + 1) / ((F.col("_before") + F.col("_after")) * F.lit(0.5) + 1)
    found = both.select("value", "n", ratio.alias("ratio")).where(F.col("ratio") > threshold)
    ranked = found.orderBy(F.desc("ratio"), F.asc("value"))
    return ranked.limit(top) if top else ranked


def drop_abnormal_counts(df: DataFrame, col: str, top: int = 2, threshold: float = 50, min_distinct: int = 10) -> DataFrame:
    """The ``top`` abnormal values of a column as NULL; columns of few values are left alone."""
    values = [r["value"] for r in abnormal_counts(df, col, top, threshold, min_distinct).collect()]
    return df.withColumn(col, F.when(~F.col(col).isin(values), F.col(col))) if values else df


def infinities_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~is_inf(F.col(c)), F.col(c)) for c in cols})


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def clean_for_model(df: DataFrame, cols: Sequence[str], max_null: float = 0.5) -> tuple[DataFrame, list[str], list[str]]:
    """(rows, kept columns, zero-variance columns): sparse columns go first, then rows with a gap or infinity."""
    nulls = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in cols]).first()
    kept = [c for c in cols if nulls["_n"] and nulls[c] / nulls["_n"] <= max_null]
    rows = df
    for c in kept:
        rows = rows.where(is_finite(F.col(c)))
    spread = rows.agg(*[F.var_pop(c).alias(c) for c in kept]).first() if kept else {}
    return rows, kept, [c for c in kept if not spread[c]]


def failed_casts(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Values that a change of column type would lose, with their counts."""
    failed = df.where(F.col(col).isNotNull() & typed(col, kind).isNull())
    return failed.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def same_value_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, is_same): columns that hold a single value.  Minimum and maximum are enough to tell."""
    stats = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in cols])
    return stats.unpivot([], list(cols), "column", "is_same")


def availability(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, ratio) of known values."""
    stats = df.agg(*[(F.count(c) / F.count(F.lit(1))).alias(c) for c in cols])
    return stats.unpivot([], list(cols), "column", "ratio")


def point_types(df: DataFrame, x: str, y: str, low: float | None = None, high: float | None = None, out: str = "y_type") -> DataFrame:
    """State of each point: unlinked, none, inf, neg_inf, outlier, neg_outlier or normal."""
    v = F.col(y)
    state = (
        F.when(F.col(x).isNull(), "unlinked")
        .when(v.isNull() | F.isnan(v), "none")
        .when(v == F.lit(float("inf")), "inf")
        .when(v == F.lit(float("-inf")), "neg_inf")
    )
    if high is not None:
        state = state.when(v > high, "outlier")
    if low is not None:
        state = state.when(v < low, "neg_outlier")
    return df.withColumn(out, state.otherwise("normal"))


def candidate_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, digits14, known): evidence for choosing date (most 14-digit values) and serial columns."""
    parts = []
    for c in cols:
        text = F.col(c).cast("string")
        parts.append(F.struct(F.lit(c).alias("column"), F.count_if(text.rlike(r"^\d{14}$")).alias("digits14"),
                              F.count(c).alias("known")))
    stats = df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)])
    return stats.select(F.explode(F.array(*stats.columns)).alias("s")).select("s.*")


def choose_date_and_serial(df: DataFrame, cols: Sequence[str], low_priority: Sequence[str] = ()) -> tuple[str | None, str | None]:
    rows = candidate_columns(df, cols).collect()
    dates = [r for r in rows if r["digits14"]]
    date = max(dates, key=lambda r: r["digits14"])["column"] if dates else next(iter(low_priority), None)
    rest = [r for r in rows if r["column"] != date and r["column"] not in low_priority and r["known"]]
    serial = max(rest, key=lambda r: r["known"])["column"] if rest else next((c for c in low_priority if c != date), None)
    return date, serial


