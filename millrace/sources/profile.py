"""Type inference: one aggregation over all columns, then a decision per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.repair import DATE_TEXT, TIME_TEXT, read_number

CATEGORY_COUNT = 256
CATEGORY_RATIO = 0.01
CATEGORY_TEXT_LENGTH = 5
MAX_SAFE_INTEGER = 2**53 - 1

# Fixed value: shape of date-time text.
DATETIME_TEXT = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}[\sT]\d{1,2}:\d{1,2}(:\d{1,2})?(\.\d+)?((\s?([+-]?\d{1,2}:\d{2})?)|Z)?$"


def column_facts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, counts of readings): what the decision needs.

    One pass counts each distinct value; every value is then read once, for all its cells.
    """
    cols = list(cols)
    text, n = F.col("value"), F.col("n")
    moment = F.regexp_replace(text, "/", "-").try_cast("timestamp")
    read = _cells(df, cols).groupBy("column", "value").agg(F.count("*").alias("n")).select(
        "column",
        "value",
        "n",
        read_number(text).alias("number"),
        F.when(text.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), moment).alias("moment"),
    )
    number, at = F.col("number"), F.col("moment")
    whole = F.floor(number) == number

    def cells(test: Column) -> Column:
        return F.sum(F.when(test, n).otherwise(0))

    facts = {
        "known": F.sum(n),
        "numbers": cells(number.isNotNull()),
        "whole": cells(whole),
        "bits": cells(number.isin(0.0, 1.0)),
        "int16": cells(whole & number.between(-(2**15), 2**15 - 1)),
        "int32": cells(whole & number.between(-(2**31), 2**31 - 1)),
        "int64": cells(whole & text.try_cast("bigint").isNotNull()),
        "double_zero": cells(F.replace(text, F.lit("'"), F.lit("")).startswith("00")),
        "moments": cells(at.isNotNull()),
        "midnights": cells(F.date_trunc("day", at) == at),
        "dates": cells(text.rlike(DATE_TEXT)),
        "times": cells(text.rlike(TIME_TEXT)),
        "booleans": cells(text.isin("true", "false")),
        "longest": F.max(F.length(text)).cast("long"),
        "plain_ints": cells(text.rlike(r"^-?(0|[1-9]\d*)$")),
        "separated": cells(text.rlike(r"^[+-]?\d+,\d+$")),
        "grouped": cells(number.isNull() & text.rlike(r"^[+-]?[\d , \.]+$")),
        "date_times": cells(text.rlike(DATETIME_TEXT)),
        "distinct": F.count("*"),
    }
    found = read.groupBy("column").agg(*[v.alias(k) for k, v in facts.items()])
    rows = {r["column"]: tuple(r) for r in found.collect()}  # one row per column
    done = [rows.get(c, (c, *[0] * len(facts))) for c in cols]
    return df.sparkSession.createDataFrame(done, "column string, " + ", ".join(f"`{k}` long" for k in facts))


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.trim(F.col(c).cast("string")).alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    return long.where(F.col("value").isNotNull())


def is_category(known: int, distinct: int) -> bool:
    if known < 32:
        return False
    if known >= 1000:
        return distinct < CATEGORY_COUNT and distinct / known <= CATEGORY_RATIO
    return distinct < 4


def import_type(f) -> str:
    """Data type of a stored column, from its facts."""
    n = f["known"]
    if n == 0:
        return "TEXT"
    category = is_category(n, f["distinct"])
    if f["numbers"] == n and f["double_zero"] == 0:
        if f["whole"] < n:
            return "REAL"
        if f["bits"] == n:
            return "BOOLEAN"
        if f["int16"] == n:
            return "SMALL_INT"
        if category:
            return "CATEGORY"
        if f["int32"] == n:
            return "INTEGER"
        return "BIG_INT" if f["int64"] == n else "TEXT"
    if f["moments"] == n:
        return "DATE" if f["midnights"] == n else "DATETIME"
    if f["dates"] == n:
        return "DATE"
    if f["times"] == n:
        return "TIME"
    if f["booleans"] == n:
        return "BOOLEAN"
    return "CATEGORY" if f["longest"] >= CATEGORY_TEXT_LENGTH and category else "TEXT"


def preview_type(f) -> str:
    """Data type proposed for a file column: text, date-time, real, integer or a separated number."""
    n = f["known"]
    if n == 0:
        return "TEXT"
    if f["plain_ints"] == n:
        return "INTEGER"
    if f["numbers"] == n:
        return "TEXT" if f["whole"] == n and f["double_zero"] else "REAL"
    if f["date_times"] == n:
        return "DATETIME"
    if f["separated"] + f["numbers"] == n:
        return "EU_REAL_SEP"
    if f["grouped"] + f["numbers"] + f["separated"] == n and f["grouped"] >= 0.1 * n:
        return "REAL_SEP"
    return "TEXT"


def infer_types(df: DataFrame, cols: Sequence[str], rule=import_type) -> dict[str, str]:
    return {r["column"]: rule(r) for r in column_facts(df, cols).collect()}  # one row per column


def types_table(df: DataFrame, cols: Sequence[str], rule=import_type) -> DataFrame:
    return df.sparkSession.createDataFrame(list(infer_types(df, cols, rule).items()), "column string, type string")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) of all columns in one job."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def merge_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Value counts of several chunks added up."""
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("column", "value").agg(F.sum("n").alias("n"))
