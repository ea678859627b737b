"""Import of one batch: validate, split off errors and duplicates, merge with history, count.

The same functions serve batch jobs and the micro-batches of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import repair
from millrace.operators import aggregate, cleaning, ordering
from millrace.session import written

# Merge flags by kind of source.
FLAGS = {"general": 0, "v2_measurement": 1, "v2_history": 2, "efa_measurement": 4, "efa_history": 8}
PARTNERS = {"v2_measurement": "v2_history", "v2_history": "v2_measurement",
            "efa_measurement": "efa_history", "efa_history": "efa_measurement"}


def current_flag(kind: str) -> int:
    return FLAGS[kind]


def missing_flag(kind: str) -> int | None:
    return FLAGS[PARTNERS[kind]] if kind in PARTNERS else None


def done_flag(kind: str) -> int:
    return FLAGS[kind] | (missing_flag(kind) or 0)


@dataclass(frozen=True)
class ImportSpec:
    """How to read one process: event time, data types, keys and time zone."""

    time: str
    types: Mapping[str, str]
    keys: tuple[str, ...] = ()
    zone: str = "UTC"
    na_texts: tuple[str, ...] = ()
    time_format: str | None = None
    date_time: tuple[str, str] | None = None


@dataclass
class ImportResult:
    good: DataFrame
    errors: DataFrame
    duplicates: DataFrame
    counts: DataFrame = field(default=None)


def null_safe(left: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in left]


#: Different rows that one task holds to count equal ones.
COUNTED_ROWS = 500_000


def repeated_rows(df: DataFrame, keys: Sequence[str], order: ordering.Order, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the last row in ``order`` is kept per key; with all columns as key any row will do.

    In that case equal rows are counted instead of sorted.  ``keep`` may write the numbered rows once for both.
    """
    if set(df.columns) <= set(keys):
        return repeated_whole_rows(df, keep)
    items = [(n, "asc" if desc else "desc") for n, desc in ordering.order_items(order)]
    numbered = keep(ordering.row_numbers(df, items, keys, "_rn"))
    return numbered.where(F.col("_rn") == 1).drop("_rn"), numbered.where(F.col("_rn") > 1).drop("_rn")


def repeated_whole_rows(df: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): one of each set of equal rows, and all others."""
    # of numbers that are equal but not the same, as 0.0 and -0.0, one is kept as it is
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    tasks = -(-df.count() // COUNTED_ROWS)
    if tasks > 1 and len(numbers) < len(df.columns):  # few copies are the rule: rows go to their tasks uncounted
        df = df.repartition(tasks, *[c for c in df.columns if c not in numbers])
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_is_{c}") for c in numbers])
    counted = keep(counted.select(*[F.col(f"_is_{c}").alias(c) if c in numbers else F.col(c) for c in df.columns], "_n"))
    # the copies of a row in two steps, so that no list is as long as they are many
    blocks = counted.where(F.col("_n") > 1).withColumn("_at", F.explode(F.sequence(F.lit(2).cast("long"), "_n", F.lit(4096).cast("long"))))
    copies = blocks.withColumn("_at", F.explode(F.sequence("_at", F.least(F.col("_at") + 4095, F.col("_n")))))
    return counted.drop("_n"), copies.drop("_n", "_at")


def distinct_by(df: DataFrame, keys: Sequence[str], order: ordering.Order) -> DataFrame:
    """One row per natural key, the first in ``order``."""
    return ordering.first_rows(df, keys, order)


def not_stored(batch: DataFrame, stored: DataFrame, time: str, cols: Sequence[str]) -> DataFrame:
    """Batch rows that are not stored yet, comparing shared columns with NULL equal to NULL.

    Stored rows are read only in the batch's time range.
    """
    lo, hi = batch.agg(F.min(time), F.max(time)).first()
    if lo is not None:
        stored = stored.where((F.col(time) >= F.lit(lo)) & (F.col(time) <= F.lit(hi)))
    renamed = stored.select(*[F.col(c).alias(f"_s_{c}") for c in cols])
    # The event time is never NULL in stored rows, so it can serve as a plain hash-join key.
    cond = [F.col(time) == F.col(f"_s_{time}")] + null_safe([c for c in cols if c != time], "_s_")
    return batch.join(renamed, cond, "left_anti")


def stored_duplicates(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(id, copies, keep): stored rows that repeat others in all ``cols``; the smallest id is the one to keep.

    The ids of a group stay in long form, as a group may be very large.
    """
    groups = df.groupBy(*cols).agg(F.count("*").alias("copies"), F.min(id_col).alias("_first")).where(F.col("copies") > 1)
    renamed = groups.select(*[F.col(c).alias(f"_g_{c}") for c in cols], "copies", "_first")
    joined = df.join(renamed, null_safe(cols, "_g_"), "inner")
    return joined.select(F.col(id_col).alias("id"), "copies", (F.col(id_col) == F.col("_first")).alias("keep"))


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: ordering.Order, right_order: ordering.Order) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, left over, right over): the k-th row of a key on one side meets the k-th on the other.

    Both sides share their columns; a known right value wins.
    """
    cols = left.columns
    l = ordering.row_numbers(left, left_order, keys, "_rn")
    r = ordering.row_numbers(right, right_order, keys, "_rn")
    renamed = r.select(*[F.col(c).alias(f"_r_{c}") for c in (*right.columns, "_rn")])
    # Rows with a NULL key never meet.
    cond = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_rn") == F.col("_r__rn")]
    both = l.join(renamed, cond, "inner")
    merged = both.select(*[F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c) if c in right.columns else F.col(c) for c in cols])
    left_over = l.join(renamed, cond, "left_anti").drop("_rn")
    l_renamed = l.select(*[F.col(c).alias(f"_l_{c}") for c in (*keys, "_rn")])
    back = [F.col(k) == F.col(f"_l_{k}") for k in keys] + [F.col("_rn") == F.col("_l__rn")]
    right_over = r.join(l_renamed, back, "left_anti").drop("_rn")
    return merged, left_over, right_over


def merge_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: ordering.Order, right_order: ordering.Order, take: Sequence[str]) -> DataFrame:
    """Left rows with columns of the right row at the same position of the key (NULL without one)."""
    l = ordering.row_numbers(left, left_order, keys, "_rn")
    r = ordering.row_numbers(right, right_order, keys, "_rn")
    renamed = r.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_rn").alias("_r_rn"), *take)
    cond = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_rn") == F.col("_r_rn")]
    return l.join(renamed, cond, "left").drop("_rn", "_r_rn", *[f"_r_{k}" for k in keys])


def import_batch(raw: DataFrame, spec: ImportSpec, stored: DataFrame | Callable[[datetime, datetime], DataFrame | None] | None = None) -> ImportResult:
    """Typed rows with event time, without repeats and without rows already stored; all others with a reason.

    ``stored`` may be a function of the batch's first and last event time, so that only that range is read.  Parsed
    rows and new rows are written once to the shared folder, and the outputs read from there.
    """
    if spec.date_time:
        timed = cleaning.event_time(raw, *spec.date_time, spec.time, spec.zone)
    elif spec.time_format:
        timed = cleaning.to_utc(cleaning.convert_datetime_formats(raw, {spec.time: spec.time_format}), spec.time, spec.zone)
    else:
        timed = cleaning.to_utc(raw.withColumn(spec.time, repair.strip_quotes(F.col(spec.time).cast("string")).try_cast("timestamp")), spec.time, spec.zone)
    typed, rejected = cleaning.cast_and_reject(written(timed), spec.types, spec.na_texts)
    good, untimed = cleaning.split_missing(typed, spec.time)
    errors = rejected.withColumn("error_reason", F.lit("no readable value")).unionByName(
        untimed.withColumn("error_reason", F.lit("no event time"))
    )
    keys = list(spec.keys) or good.columns
    rest = [c for c in good.columns if c not in keys]
    kept, dropped = repeated_rows(good, keys, [spec.time, *[c for c in rest if c != spec.time]], written)
    fresh = kept
    if callable(stored):
        lo, hi = kept.agg(F.min(spec.time), F.max(spec.time)).first()
        stored = stored(lo, hi) if lo is not None else None
    if stored is not None:
        # a column that one side lacks is NULL there
        for c in (c for c in stored.columns if c not in kept.columns):
            stored = stored.where(F.col(c).isNull())
        stored = stored.withColumns({f.name: F.lit(None).cast(f.dataType) for f in kept.schema if f.name not in stored.columns})
        fresh = written(not_stored(kept, stored, spec.time, kept.columns))
    return ImportResult(fresh, errors, dropped, aggregate.hourly_counts(fresh, spec.time))


def retention(df: DataFrame, time: str, keep_from: datetime) -> DataFrame:
    """Rows that survive cleaning by age."""
    return df.where(F.col(time) >= F.lit(keep_from).cast("timestamp"))


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows whose id was not archived upstream."""
    return df.join(gone.select(F.col(gone.columns[0]).alias("_gone")), F.col(id_col) == F.col("_gone"), "left_anti")


def batches_to_send(batches: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """Whole import batches in order until their row count passes ``limit``, at least one."""
    total = ordering.running_sum(batches, size, [order], out="_sum")
    return total.where(F.col("_sum") - F.col(size) <= limit).drop("_sum")


def union_columns(stored: DataFrame, restored: DataFrame) -> DataFrame:
    """Restored rows on the stored columns: unknown columns are dropped, missing ones are NULL."""
    shared = restored.select(*[c for c in restored.columns if c in stored.columns])
    return stored.unionByName(shared, allowMissingColumns=True)
