"""Ordering, thinning, terms, chunks and other series operators."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import epoch_us, is_finite, is_inf
from millrace.operators import ordering
from millrace.operators.ordering import Order
from millrace.operators.quantiles import modes, quantiles, ranked_values
from millrace.operators.summary import join_on_keys, to_rows

THIN_SLOTS = 4000


def sort_by(df: DataFrame, order: Order) -> DataFrame:
    """Global sort; Spark range-partitions it."""
    return df.orderBy(*[F.desc_nulls_last(n) if d else F.asc_nulls_last(n) for n, d in ordering.order_items(order)])


def with_slot(df: DataFrame, time: str | None, order: Order, slots: int = THIN_SLOTS) -> DataFrame:
    """Slot number by equal time spans, or by equal row counts in ``order`` when no time is given."""
    if time is not None:
        lo, hi = df.agg(F.min(epoch_us(F.col(time))), F.max(epoch_us(F.col(time)))).first()
        if lo is None:
            return df.withColumn("slot", F.lit(None).cast("long"))
        # The span is counted in nanoseconds with one added, so that the last record falls into the last slot.
        width = ((hi - lo) * 1000 + 1) / slots
        return df.withColumn("slot", F.floor((epoch_us(F.col(time)) - F.lit(lo)) * 1000 / F.lit(width)).cast("long"))
    rows = df.count()
    size = max(1, -(-rows // slots))
    numbered = ordering.row_numbers(df, order, out="_rn", rows=rows)
    return numbered.withColumn("slot", F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long")).drop("_rn")


def thin(
    df: DataFrame,
    cols: Sequence[str],
    time: str,
    categories: Sequence[str] = (),
    by_time: bool = True,
    order: Order = (),
    slots: int = THIN_SLOTS,
) -> DataFrame:
    """Per slot: first and last time, row count, minimum, median and maximum of each column, mode of categories.

    Infinities and NULLs do not count, unless a slot has nothing else.
    """
    slotted = with_slot(df, time if by_time else None, order or [time], slots).where(F.col("slot").isNotNull())
    number = {c: F.col(c).cast("double") for c in cols}
    usable = {c: F.when(is_finite(x), x) for c, x in number.items()}
    endless = {c: F.when(is_inf(x), x) for c, x in number.items()}
    aggs = [F.min(time).alias("time_from"), F.max(time).alias("time_to"), F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.coalesce(F.min(usable[c]), F.min(endless[c])).alias(f"{c}_min"),
                 F.coalesce(F.max(usable[c]), F.max(endless[c])).alias(f"{c}_max")]
    out = slotted.groupBy("slot").agg(*aggs)
    alive = slotted.select("slot", *[usable[c].alias(c) for c in cols])
    middles = quantiles(alive, cols, [0.5], ["slot"], names=["m"])
    wide = middles.groupBy("slot").agg(*[F.max(F.when(F.col("variable") == c, F.col("m"))).alias(f"{c}_median") for c in cols])
    out = join_on_keys(out, wide, ["slot"])
    for c in cols:
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        only_inf = F.when(lo == hi, lo)
        out = out.withColumn(f"{c}_median", F.coalesce(f"{c}_median", only_inf))
    for c in categories:
        out = join_on_keys(out, modes(slotted, c, ["slot"], f"{c}_mode"), ["slot"])
    return out


def even_ranks(first: int, last: int, count: int) -> list[int]:
    """``count`` ranks spread evenly from first to last, rounded down."""
    return [first + (last - first) * i // max(count - 1, 1) for i in range(count)]


def resample_positions(n: int, wanted: int) -> tuple[list[int], list[int]]:
    """(ranks taken as they are, the one or two ranks whose mean is the median) for ``resample``.

    Half of the ranks lie below the median and half above it.
    """
    half = wanted // 2
    middle = [n // 2] if n % 2 else [n // 2 - 1, n // 2]
    return even_ranks(0, n // 2 - 2, half) + even_ranks((n + 1) // 2, n - 1, half), middle


def resample(df: DataFrame, col: str, wanted: int) -> DataFrame:
    """About ``wanted`` values that keep minimum, median and maximum: evenly spaced ranks below and above the median.

    Only the buckets that hold a wanted rank are sorted.
    """
    values = df.select(F.col(col).cast("double").alias("value")).where(F.col(col).isNotNull())
    n = values.count()
    if n <= wanted + 1 - wanted % 2:
        return values
    plain, middle = resample_positions(n, wanted)
    every = F.array(*[F.lit(i).cast("long") for i in dict.fromkeys([*plain, *middle])])
    found = ranked_values(values, [], lambda _n: every, n)
    marks = df.sparkSession.createDataFrame([(i, False) for i in plain] + [(i, True) for i in middle], "pos long, mid boolean")
    both = marks.join(found.select("pos", "value"), "pos")
    centre = both.where("mid").agg(F.avg("value").alias("value"))
    return both.where(~F.col("mid")).select("value").unionByName(centre)


def cyclic_terms(start: datetime, count: int, interval_hours: float, window_hours: float) -> list[tuple[datetime, datetime]]:
    """``count`` windows of equal length, each ``interval_hours`` after (or before) the previous one."""
    step, width = timedelta(hours=interval_hours), timedelta(hours=window_hours)
    return [(start + i * step, start + i * step + width) for i in range(count)]


def in_cyclic_terms(df: DataFrame, time: str, start: datetime, count: int, interval_hours: float, window_hours: float, out: str = "term") -> DataFrame:
    """One row per record and term [start, end) it lies in, by arithmetic on the term number."""
    step, width = round(interval_hours * 3.6e9), round(window_hours * 3.6e9)
    since = epoch_us(F.col(time)) - epoch_us(F.lit(start).cast("timestamp"))
    if step == 0:
        inside = (since >= 0) & (since < F.lit(width))
        return df.where(inside).withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    # Term i holds a record when i * step <= since < i * step + width.
    if step > 0:
        first, last = F.floor((since - width) / F.lit(step)) + 1, F.floor(since / F.lit(step))
    else:
        first, last = F.ceil(since / F.lit(step)), F.ceil((since - width) / F.lit(step)) - 1
    first = F.greatest(first.cast("int"), F.lit(0))
    last = F.least(last.cast("int"), F.lit(count - 1))
    terms = F.when(first <= last, F.sequence(first, last))
    return df.withColumn(out, F.explode(terms))


def in_terms(df: DataFrame, time: str, terms: Sequence[tuple[datetime, datetime]], out: str = "term") -> DataFrame:
    """One row per record and listed term [start, end) it lies in."""
    hits = []
    for i, (lo, hi) in enumerate(terms):
        inside = (F.col(time) >= F.lit(lo).cast("timestamp")) & (F.col(time) < F.lit(hi).cast("timestamp"))
        hits.append(F.when(inside, F.lit(i)))
    return df.withColumn(out, F.explode(F.array_compact(F.array(*hits))))


def calendar_division(df: DataFrame, time: str, bounds: Sequence[datetime], labels: Sequence[str], out: str = "division") -> DataFrame:
    """Label of the period [bounds[i], bounds[i+1]); records outside are dropped."""
    label = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(bounds, bounds[1:], labels))):
        inside = (F.col(time) >= F.lit(lo).cast("timestamp")) & (F.col(time) < F.lit(hi).cast("timestamp"))
        label = F.when(inside, F.lit(name)).otherwise(label)
    return df.withColumn(out, label).where(F.col(out).isNotNull())


def chunks(df: DataFrame, size: int, order: Order, keys: Sequence[str] = (), out: str = "chunk") -> DataFrame:
    """Consecutive chunks of ``size`` rows, numbered from 0."""
    numbered = ordering.row_numbers(df, order, keys, "_rn")
    return numbered.withColumn(out, F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long")).drop("_rn")


def keep_chunks(df: DataFrame, most: int, latest: bool, keys: Sequence[str] = (), chunk: str = "chunk") -> DataFrame:
    """The first or the latest ``most`` chunks of each group."""
    if not latest:
        return df.where(F.col(chunk) < most)
    last = df.groupBy(*keys).agg(F.max(chunk).alias("_last"))
    return to_rows(df, last, keys).where(F.col(chunk) > F.col("_last") - most).drop("_last")


def limit_groups(df: DataFrame, key: str, most_groups: int, rows_each: int, order: Order, descending: bool = False) -> DataFrame:
    """The first ``most_groups`` groups by key, ``rows_each`` rows of each: a display limit."""
    direction = F.desc(key) if descending else F.asc(key)
    groups = df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(direction).limit(most_groups)
    return ordering.first_rows(df.join(groups, key, "left_semi"), [key], order, rows_each)


def start_period(df: DataFrame, start_time: str, end_time: str, act_from: datetime | None, act_to: datetime | None) -> DataFrame:
    """Validity period given in end-process time, expressed in start-process time of the linked records."""
    rows = df.where(F.col(end_time).isNotNull())
    if act_from is not None:
        rows = rows.where(F.col(end_time) >= F.lit(act_from).cast("timestamp"))
    if act_to is not None:
        rows = rows.where(F.col(end_time) < F.lit(act_to).cast("timestamp"))
    at = F.struct(F.col(end_time), F.col(start_time))
    return rows.agg(F.min_by(start_time, at).alias("start_from"), F.max_by(start_time, at).alias("start_to"))


def threshold_index(time: Column, periods: Sequence[tuple[datetime | None, datetime | None]]) -> Column:
    """Index of the threshold in force at a time: of those that cover it the one that ends last, else the first."""
    far = datetime(9999, 1, 1)
    order = sorted(range(len(periods)), key=lambda i: periods[i][1] or far, reverse=True)
    out = F.lit(0)
    for i in reversed(order):
        lo, hi = periods[i]
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (time >= F.lit(lo).cast("timestamp"))
        if hi is not None:
            inside = inside & (time <= F.lit(hi).cast("timestamp"))
        out = F.when(time.isNotNull() & inside, F.lit(i)).otherwise(out)
    return out


def latest(df: DataFrame, order: Order, n: int) -> DataFrame:
    """Preview of the newest ``n`` records."""
    items = [(name, "asc" if desc else "desc") for name, desc in ordering.order_items(order)]
    return sort_by(df, items).limit(n)


def day_ranges(df: DataFrame, time: str) -> DataFrame:
    """(day_from, day_to) contiguous days with data, end exclusive."""
    days = df.where(F.col(time).isNotNull()).select(F.to_date(time).alias("day")).distinct()
    numbered = ordering.row_numbers(days, ["day"], out="_rn")
    islands = numbered.groupBy(F.date_sub("day", F.col("_rn").cast("int")).alias("_g"))
    return islands.agg(F.min("day").alias("day_from"), F.date_add(F.max("day"), 1).alias("day_to")).drop("_g")


def plot_rows(df: DataFrame, axes: Sequence[str], color: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of a scatter plot: axes, colour and facets, complete rows only."""
    cols = list(dict.fromkeys([*axes, *([color] if color else []), *keys]))
    return df.select(*cols).dropna(subset=cols)


def scatter_type(x_is_category: bool, y_is_category: bool) -> str:
    """Two numbers make a scatter plot, two categories a heatmap, a mix a violin plot."""
    if x_is_category and y_is_category:
        return "heatmap"
    return "violin" if x_is_category or y_is_category else "scatter"
