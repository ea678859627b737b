"""Linking records of different processes by keys, key substrings and time offsets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numeric import epoch_us
from millrace.operators import ordering
from millrace.operators.hotkeys import spread_join
from millrace.spec import DuplicateShow, LinkKey

MINUTE = 60_000_000


def time_window(df: DataFrame, time: str, start: datetime | str, end: datetime | str) -> DataFrame:
    """Records in [start, end); the comparison is pushed into the scan."""
    at = F.col(time)
    return df.where((at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))


def end_window(start: datetime, end: datetime, buffer_days: int = 14) -> tuple[datetime, datetime]:
    """Window searched on linked processes: the start window widened on both sides."""
    return start - timedelta(days=buffer_days), end + timedelta(days=buffer_days)


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.VarcharType, T.CharType))


def _key_value(df: DataFrame, name: str, substr: tuple[int, int] | None) -> tuple[Column, bool]:
    if substr is None:
        return F.col(name), _is_text(df, name)
    return F.substring(F.col(name).cast("string"), substr[0], substr[1] - substr[0] + 1), True


def key_values(left: DataFrame, right: DataFrame, keys: Sequence[LinkKey]) -> list[tuple[Column, Column]]:
    """Comparable key expressions of both sides; text against number compares as text."""
    pairs = []
    for k in keys:
        l, l_text = _key_value(left, k.self_column, k.self_substr)
        r, r_text = _key_value(right, k.target_column, k.target_substr)
        if l_text != r_text:
            l, r = l.cast("string"), r.cast("string")
        pairs.append((l, r))
    return pairs


def equi_link(left: DataFrame, right: DataFrame, keys: Sequence[LinkKey], filtered: bool = False, find: str = "lr") -> DataFrame:
    """Link by equality of all keys: a left join, or an inner join when the linked process carries a filter.

    Column names of both sides must differ.  Hot keys of either side, and left rows without a key, are dealt over
    several tasks (``hotkeys.spread_join``, which tells ``find``).
    """
    pairs = key_values(left, right, keys)
    l = left.select("*", *[a.alias(f"_l{i}") for i, (a, _) in enumerate(pairs)])
    r = right.select("*", *[b.alias(f"_r{i}") for i, (_, b) in enumerate(pairs)])
    names = [f"{side}{i}" for side in ("_l", "_r") for i in range(len(pairs))]
    return spread_join(l, r, names[: len(pairs)], names[len(pairs) :], filtered, find=find).drop(*names)


def number_duplicates(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], out: str) -> DataFrame:
    """Number records that share a key, newest first, so that the k-th can be linked with the k-th."""
    return ordering.row_numbers(df, [(time, "desc"), *tie], keys, out)


def one_per_key(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], show: DuplicateShow) -> DataFrame:
    """Earliest or latest record per link key."""
    if show is DuplicateShow.BOTH or not keys:
        return df
    first = (time, "asc" if show is DuplicateShow.FIRST else "desc")
    return ordering.first_rows(df, keys, [first, *tie])


def time_link(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    delta_minutes: float,
    cut_off_minutes: float = 0.0,
    keys: Sequence[LinkKey] = (),
    filtered: bool = False,
    earlier: bool = False,
) -> DataFrame:
    """Link to the record nearest to ``left_time + delta`` within ``± cut_off`` (exclusive) and strictly later.

    With ``earlier`` the record must be strictly earlier instead: a link followed against its direction, from the
    later record and with the sign of ``delta`` turned.

    All records at the nearest distance are kept.  No pair outside the result is built: the distinct times of the
    right side and the wanted times of the left side are merged in one order, each wanted time looks at its
    neighbours, and only the chosen time is joined.  A zero ``cut_off`` gives an empty interval, hence no match.
    """
    delta, cut = round(delta_minutes * MINUTE), abs(round(cut_off_minutes * MINUTE))
    pairs = key_values(left, right, keys)
    names = [f"_q{i}" for i in range(len(pairs))]
    l_us, r_us = epoch_us(F.col(left_time)), epoch_us(F.col(right_time))

    known = right.select(*[b.alias(n) for n, (_, b) in zip(names, pairs)], r_us.alias("_t"))
    known = known.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in known.columns])).distinct()
    row = F.struct(*[F.col(c) for c in left.columns])
    marks = left.select(*[a.alias(n) for n, (a, _) in zip(names, pairs)], l_us.alias("_from"), row.alias("_row"))
    # Later-only: with a negative offset every time up to the start is out, so the search begins at the start.
    # Earlier-only: the other way round, and a mark comes before the times equal to it.
    marks = marks.withColumn("_t", F.col("_from") + F.lit(min(delta, 0) if earlier else max(delta, 0)))
    merged = known.withColumns({"_known": F.col("_t"), "_side": F.lit(0)}).unionByName(
        marks.withColumns({"_known": F.lit(None).cast("long"), "_side": F.lit(-1 if earlier else 1)}), allowMissingColumns=True
    )
    around = ordering.known_around(merged, "_known", ["_t", "_side"], names, before="_prev", after="_next")
    centre = F.col("_from") + F.lit(delta)

    def distance(t: str) -> Column:
        away = F.abs(F.col(t) - centre)
        allowed = F.col(t) < F.col("_from") if earlier else F.col(t) > F.col("_from")
        return F.when(allowed & (away < F.lit(cut)), away)

    chosen = (
        around.where(F.col("_side") != 0)
        .withColumns({"_dp": distance("_prev"), "_dn": distance("_next")})
        .withColumn("_best", F.least("_dp", "_dn"))
        .withColumn(
            "_at",
            F.array_compact(
                F.array_distinct(
                    F.array(
                        F.when(F.col("_dp") == F.col("_best"), F.col("_prev")),
                        F.when(F.col("_dn") == F.col("_best"), F.col("_next")),
                    )
                )
            ),
        )
        .select("_row", *names, F.explode_outer("_at").alias("_at"))
    )
    target = right.select("*", *[b.alias(f"_r{n}") for n, (_, b) in zip(names, pairs)], r_us.alias("_rt"))
    out = spread_join(chosen, target, [*names, "_at"], [*[f"_r{n}" for n in names], "_rt"], filtered, find="r")
    return out.select("_row.*", *right.columns)


def linked_rows(left: DataFrame, right: DataFrame, keys: Sequence[LinkKey]) -> DataFrame:
    """Left records that have a match (semi join): the basis of link counts."""
    pairs = key_values(left, right, keys)
    l = left.select("*", *[a.alias(f"_l{i}") for i, (a, _) in enumerate(pairs)])
    r = right.select(*[b.alias(f"_r{i}") for i, (_, b) in enumerate(pairs)])
    cond = [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(len(pairs))]
    return l.join(r, cond, "left_semi").drop(*[f"_l{i}" for i in range(len(pairs))])


def link_counts(edges: Sequence[tuple[str, DataFrame, DataFrame, Sequence[LinkKey]]]) -> DataFrame:
    """(edge, total, linked) of proposed links, over all records."""
    parts = []
    for name, left, right, keys in edges:
        total = left.agg(F.count("*").alias("n")).select(F.lit(name).alias("edge"), F.col("n"), F.lit(0).alias("m"))
        hits = linked_rows(left, right, keys).agg(F.count("*").alias("m"))
        parts += [total.select("edge", "n", F.col("m").cast("long")), hits.select(F.lit(name).alias("edge"), F.lit(0).cast("long").alias("n"), "m")]
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy("edge").agg(F.sum("n").alias("total"), F.sum("m").alias("linked"))


def unique_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Number of distinct start records in a linked result."""
    return df.agg(F.count_distinct(id_col).alias("unique_ids"))


def one_per_start(df: DataFrame, id_col: str, order: ordering.Order) -> DataFrame:
    """After linking, one row per start record: the first in ``order`` (use descending times to keep the last)."""
    return ordering.first_rows(df, [id_col], order)


def combine_paths(base: DataFrame, other: DataFrame, id_col: str) -> DataFrame:
    """Add the columns another path found for the same start records."""
    fresh = [c for c in other.columns if c not in base.columns]
    return base.join(other.select(id_col, *fresh), id_col, "inner")


def term_of(value: Column, terms: Sequence[tuple[datetime, datetime]], use_from: bool) -> Column:
    """Start (or end) of the first listed term that contains the time, both ends included."""
    out = F.lit(None).cast("timestamp")
    for lo, hi in reversed(list(terms)):
        lo_c, hi_c = F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")
        out = F.when((value >= lo_c) & (value <= hi_c), lo_c if use_from else hi_c).otherwise(out)
    return out


def point_details(linked: DataFrame, id_col: str, value, columns: Sequence[str]) -> DataFrame:
    """(id, item, value) rows of one clicked record and what is linked with it."""
    row = linked.where(F.col(id_col) == F.lit(value))
    texts = row.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(["id"], list(columns), "item", "value").distinct()
