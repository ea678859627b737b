"""Null, NaN and infinity handling that is right with ANSI mode on and off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def double(x: Column) -> Column:
    return x.cast("double")


def is_inf(x: Column) -> Column:
    return F.abs(x) == F.lit(INF)


def is_finite(x: Column) -> Column:
    """True for a real number; false for NULL, NaN and both infinities."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def ratio(num: Column, den: Column) -> Column:
    """IEEE division with 0/0 as NULL: x/0 keeps the sign of x as an infinity."""
    by_zero = F.when(num > 0, F.lit(INF)).when(num < 0, F.lit(-INF))
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def epoch_us(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp column, as a long."""
    return F.unix_micros(t.cast("timestamp"))


def epoch_s(t: Column) -> Column:
    """Seconds since 1970 with fraction, as a double."""
    return epoch_us(t) / F.lit(1e6)


def from_epoch_us(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long"))
