"""strftime patterns expressed with Spark's datetime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime directive -> Spark datetime pattern.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%a": "EEE",
    "%A": "EEEE",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "DDD",
    "%p": "a",
    "%z": "xx",
}


def _pieces(fmt: str) -> list[str]:
    return re.findall(r"%.|[^%]+", fmt)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#]", text) else text


def spark_pattern(fmt: str) -> str:
    out = []
    for piece in _pieces(fmt):
        if piece == "%%":
            out.append("%")
        elif piece.startswith("%"):
            if piece not in DIRECTIVES:
                raise ValueError(f"strftime directive {piece} has no Spark pattern")
            out.append(DIRECTIVES[piece])
        else:
            out.append(_quoted(piece))
    return "".join(out)


def parse_time(text: Column, fmt: str) -> Column:
    """Timestamp from text in a strftime format, NULL when it does not match."""
    return F.try_to_timestamp(text, F.lit(spark_pattern(fmt)))


def _weekday_name(t: Column, full: bool) -> Column:
    return F.date_format(t, "EEEE" if full else "EEE")


def sunday_week(t: Column) -> Column:
    """%U: week of the year with Sunday as first day, days before the first Sunday in week 0."""
    return F.floor((F.dayofyear(t) + 6 - (F.dayofweek(t) - 1)) / 7)


def format_time(t: Column, fmt: str) -> Column:
    """Text of a timestamp in a strftime format."""
    if "%U" not in fmt and "%a" not in fmt and "%A" not in fmt:
        return F.date_format(t, spark_pattern(fmt))
    parts = []
    for piece in _pieces(fmt):
        if piece == "%U":
            parts.append(F.lpad(sunday_week(t).cast("string"), 2, "0"))
        elif piece in ("%a", "%A"):
            parts.append(_weekday_name(t, piece == "%A"))
        elif piece == "%%":
            parts.append(F.lit("%"))
        elif piece.startswith("%"):
            parts.append(F.date_format(t, spark_pattern(piece)))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)
