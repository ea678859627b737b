"""Predicates, outlier removal, duplicates and match checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.equations import java_regex
from millrace.functions.numeric import is_finite, is_inf
from millrace.operators import ordering
from millrace.operators.ordering import Order
from millrace.operators.quantiles import quantile_literals
from millrace.spec import DuplicateShow, FilterSpec


def condition(spec: FilterSpec) -> Column:
    """One filter condition.  ``%`` and ``_`` in searched text stand for themselves."""
    col = F.col(spec.column)
    text = col.cast("string")
    values = list(spec.values)
    if spec.op == "matches":
        return col.isin(values)
    tests = {
        "startswith": lambda v: text.startswith(v),
        "endswith": lambda v: text.endswith(v),
        "contains": lambda v: text.contains(v),
        "substring": lambda v: F.substring(text, spec.position, len(v)) == v,
        "regex": lambda v: text.rlike(java_regex(v)),
        "and_search": lambda v: all_of([text.contains(w) for w in sorted(set(v.split()))]),
        "or_search": lambda v: any_of([text.contains(w) for w in v.split()]),
    }
    if spec.op not in tests:
        raise ValueError(f"unknown filter {spec.op!r}")
    return any_of([tests[spec.op](v) for v in values])


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def apply_filters(df: DataFrame, filters: Sequence[Sequence[FilterSpec]]) -> DataFrame:
    """AND of filters; the conditions inside one filter are OR-ed."""
    tests = [any_of([condition(s) for s in group]) for group in filters if group]
    return df.where(all_of(tests)) if tests else df


def on_demand(df: DataFrame, chosen: dict[str, Sequence]) -> DataFrame:
    """Keep listed values per column; a listed ``None`` also keeps NULL, NaN and infinities."""
    tests = []
    for name, values in chosen.items():
        if not values:
            continue
        col, known = F.col(name), [v for v in values if v is not None]
        parts = [col.isin(known)] if known else []
        if None in values:
            parts.append(col.isNull())
            if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
                parts += [F.isnan(col), is_inf(col)]
        tests.append(any_of(parts))
    return df.where(all_of(tests)) if tests else df


# Outlier rule -> (rows made empty, lower share, reach in interquartile ranges).
OUTLIER_RULES = {
    "O6M": ("outside", 0.25, 2.5),
    "O6I": ("inside", 0.25, 2.5),
    "O6U": ("below_upper", 0.25, 2.5),
    "O6L": ("above_lower", 0.25, 2.5),
    "O4M": ("outside", 0.25, 1.5),
    "O4I": ("inside", 0.25, 1.5),
    "O4U": ("below_upper", 0.25, 1.5),
    "O4L": ("above_lower", 0.25, 1.5),
    "OP1": ("outside", 0.01, 0.0),
    "OP5": ("outside", 0.05, 0.0),
}


def remove_outliers(df: DataFrame, cols: Sequence[str], rule: str, real_only: bool = False) -> DataFrame:
    """Make outliers NULL.  A column with equal quartiles is left alone."""
    action, share, reach = OUTLIER_RULES[rule]
    if real_only:
        cols = [c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    found = quantile_literals(df, cols, [share, 1 - share, 0.25, 0.75])
    changed = {}
    for name, (low, high, q1, q3) in found.items():
        if q1 == q3:
            continue
        lower, upper = low - reach * (high - low), high + reach * (high - low)
        x = F.col(name)
        drop = {
            "outside": (x < lower) | (x > upper),
            "inside": (x > lower) & (x < upper),
            "below_upper": x < upper,
            "above_lower": x > lower,
        }[action]
        changed[name] = F.when(~drop, x)
    return df.withColumns(changed) if changed else df


def drop_serial_duplicates(
    df: DataFrame, serials: Sequence[str], order: Order, show: DuplicateShow = DuplicateShow.LAST
) -> DataFrame:
    """Keep the first or last record of each serial in ``order`` (all with ``BOTH``)."""
    if show is DuplicateShow.BOTH:
        return df
    items = ordering.order_items(order)
    if show is DuplicateShow.LAST:
        items = [(n, not desc) for n, desc in items]
    return ordering.first_rows(df, serials, [(n, "desc" if d else "asc") for n, d in items])


def matched_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """(value, found) for each configured filter value."""
    kind = df.schema[column].dataType
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], T.StructType([T.StructField("value", kind)]))
    present = df.where(F.col(column).isin(list(values))).select(F.col(column).alias("value"), F.lit(True).alias("found"))
    return wanted.join(present.distinct(), "value", "left").select("value", F.coalesce("found", F.lit(False)).alias("found"))


def filter_catalogue(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) pairs offered as default filters."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    return long.where(F.col("value").isNotNull()).distinct()


def choices(df: DataFrame, columns: Sequence[str], chosen: dict[str, Sequence]) -> DataFrame:
    """Distinct values left per column once the chosen on-demand values are applied."""
    return filter_catalogue(on_demand(df, chosen), columns)


def finite_only(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(all_of([is_finite(F.col(c)) for c in cols]))
