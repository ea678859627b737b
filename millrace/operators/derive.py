"""Derived columns on frames: the equation chain and data-dependent encodings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import equations as eq
from millrace.functions.numeric import epoch_us
from millrace.operators import ordering
from millrace.operators.lookup import look_up
from millrace.operators.ordering import Order
from millrace.operators.quantiles import quantiles
from millrace.operators.summary import to_rows

__all__ = [
    "apply_equations",
    "category_codes",
    "category_rank",
    "combination_label",
    "cycle_time",
    "discretise",
    "elapsed_seconds",
    "fill_missing",
    "label_by_statistic",
    "others",
    "shift_rows",
    "significant",
    "value_counts",
]


def shift_rows(df: DataFrame, p: eq.EquationSpec, order: Order, keys: Sequence[str] = ()) -> DataFrame:
    """Shift by ``t`` rows with fill value ``s`` (whole frame order unless ``keys`` are given)."""
    out = p.out or p.x
    fill_value = eq.constant(p.s if p.s is not None else "0", p.x_type)
    kind = p.x_type
    if not isinstance(fill_value, {"real": (int, float), "int": int, "text": str, "bool": bool}[p.x_type]):
        kind = "real" if isinstance(fill_value, float) else "text"
    typed = df.withColumn("_x", eq.to_type(F.col(p.x), kind))
    moved = ordering.shift(typed, "_x", int(p.t or 1), order, keys, fill_value, "_y")
    return moved.withColumn(out, F.col("_y")).drop("_x", "_y")


def fill_missing(df: DataFrame, p: eq.EquationSpec, order: Order, keys: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs by the letters of ``t`` in turn: c constant, b last known value, f next known value.

    The letters' meaning follows the implemented behaviour, not their names.
    """
    out, letters = p.out or p.x, (p.t or "c").strip()
    if letters not in ("c", "b", "f", "bc", "fc", "bf", "fb"):
        raise ValueError("t must be one of c, b, f, bc, fc, bf, fb")
    framed = df.withColumn("_x", eq.to_type(F.col(p.x), p.x_type))
    for letter in letters:
        if letter == "c":
            framed = framed.withColumn("_x", F.coalesce("_x", F.lit(eq.constant(p.s or "0", p.x_type))))
        else:
            framed = ordering.fill(framed, "_x", order, keys, forward=letter == "b")
    return framed.withColumn(out, F.col("_x")).drop("_x")


def apply_equations(
    df: DataFrame, specs: Sequence[eq.EquationSpec], order: Order = (), keys: Sequence[str] = ()
) -> DataFrame:
    """Apply specs in order; later ones may use columns of earlier ones."""
    for p in specs:
        base = eq.base_id(p.fn)
        if p.out is None or eq.overwrites_input(p.fn):
            p = replace(p, out=p.out or p.x)
        if base in eq.ORDERED_IDS:
            if not order:
                raise ValueError(f"function {p.fn} depends on row order: pass order=")
            df = (shift_rows if base == 80 else fill_missing)(df, p, order, keys)
            continue
        if base == 42 and p.t is None:
            text = eq.evaluate(p)
            broken = df.select(F.count_if(text.isNotNull() & text.try_cast("long").isNull()).alias("n")).first()["n"]
            p = replace(p, t="Int" if broken == 0 else "Str")
        df = df.withColumn(p.out, eq.evaluate(p))
    return df


def category_rank(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Integer rank (1..k, sorted) of a text column; NULL keeps no rank.

    Ranks are given to the distinct values and joined back, so no window runs over rows.
    """
    out = out or f"{col}_rank"
    ranks = ordering.row_numbers(df.where(F.col(col).isNotNull()).select(col).distinct(), [col], out=out)
    columns = [c for c in df.columns if c != out]
    return look_up(df.select(*columns), ranks.withColumnRenamed(col, "_ranked"), [(F.col(col), "_ranked")]).select(*columns, out)


def category_codes(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Codes 0..k-1 in sorted order and -1 for NULL."""
    out = out or f"{col}_code"
    ranked = category_rank(df, col, out)
    return ranked.withColumn(out, F.coalesce(F.col(out) - 1, F.lit(-1).cast("long")))


def discretise(df: DataFrame, col: str, bins: int = 10, out: str | None = None) -> DataFrame:
    """Equal-width bins; each value becomes the mean of its bin.  With at most ``bins`` distinct values: unchanged."""
    out = out or col
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    few = df.where(F.col(col).isNotNull()).select(col).distinct().limit(bins + 1).count() <= bins
    if few or lo is None:
        return df.withColumn(out, F.col(col))
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col(col) - lo) / F.lit(width)), F.lit(bins - 1))
    framed = df.withColumn("_bin", slot)
    means = framed.groupBy("_bin").agg(F.avg(col).alias("_mean"))
    joined = framed.join(F.broadcast(means), "_bin", "left")  # at most ``bins`` + 1 rows
    return joined.withColumn(out, F.col("_mean")).drop("_bin", "_mean")


def cycle_time(df: DataFrame, time: str, tie: str, keys: Sequence[str] = (), out: str = "cycle_time") -> DataFrame:
    """Seconds to the next record (per key); 0 and values from five times the median upwards become NULL."""
    framed = ordering.shift(df.withColumn("_us", epoch_us(F.col(time))), "_us", -1, [time, tie], keys, None, "_next")
    gap = (F.col("_next") - F.col("_us")) / F.lit(1e6)
    framed = framed.withColumn(out, F.when(gap != 0, gap)).drop("_us", "_next")
    limits = quantiles(framed, [out], [0.5], keys, names=["_median"]).drop("variable")
    framed = to_rows(framed, limits, keys)
    return framed.withColumn(out, F.when(F.col(out) < 5 * F.col("_median"), F.col(out))).drop("_median")


def elapsed_seconds(df: DataFrame, time: str, out: str = "elapsed") -> DataFrame:
    """Seconds since the earliest record."""
    first = df.agg(F.min(epoch_us(F.col(time)))).first()[0]
    return df.withColumn(out, (epoch_us(F.col(time)) - F.lit(first)) / F.lit(1e6))


def significant(x, digits: int = 4):
    """Round to significant digits, for display."""
    size = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - size)
    return F.when(x == 0, x).when(F.abs(x) == F.lit(eq.INF), x).otherwise(F.rint(x * scale) / scale)


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Distinct values with their counts, most frequent first; ``top`` is the report length."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    ranked = counts.orderBy(F.desc("n"), F.asc("value"))
    return ranked.limit(top) if top else ranked


def combination_label(df: DataFrame, cols: Sequence[str], out: str = "facet", missing: str = "NA") -> DataFrame:
    """``a | b`` label of several category columns, missing values shown as ``missing``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in cols]
    return df.withColumn(out, F.concat_ws(" | ", *parts))


def label_by_statistic(df: DataFrame, col: str, target: str, how: str = "mean", nominal: bool = True) -> DataFrame:
    """Code per value of ``col``: by the mean or median of ``target`` (nominal) or by sort order."""
    if how == "mean":
        stats = df.groupBy(col).agg(F.avg(target).alias("stat"))
    else:
        stats = quantiles(df, [target], [0.5], [col], names=["stat"]).drop("variable")
    coded = ordering.row_numbers(stats, ["stat", col] if nominal else [col], out="code")
    return coded.withColumn("code", F.col("code") - 1)


def others(df: DataFrame, col: str, out: str, keep: int = 9, other: str = "Other") -> DataFrame:
    """Keep the most frequent groups and name the rest ``other``, so at most ``keep`` labels remain."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    top = [r[col] for r in counts.orderBy(F.desc("_n"), F.asc(col)).limit(keep + 1).collect()]
    if len(top) <= keep:
        return df.withColumn(out, F.col(col))
    return df.withColumn(out, F.when(F.col(col).isin(top[: keep - 1]), F.col(col)).when(F.col(col).isNotNull(), other))


