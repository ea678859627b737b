"""Text repair: dates, times, numbers with separators, irregular characters, sentinel values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts read as missing, as infinity and as minus infinity.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
            "NA", "NULL", "NaN", "n/a", "nan", "null", "na", "-", "--", "---", "#NULL!", "#REF!", "#VALUE!", "#NUM!",
            "#NAME?", "0/0"]
INF_TEXTS = ["Inf", "Infinity", "1/0", "#DIV/0!"]
NEG_INF_TEXTS = ["-Inf", "-Infinity", "-1/0"]

# Shapes of sentinel numbers and texts.
SENTINEL_POS = [r"^(9{4,}(\.0+)?|9{1,3}\.9{3,}0*)$", r"^((\d)\2{3,}(\.0+)?|([^36])\4{0,2}\.\4{3,}0*)$"]
SENTINEL_NEG = [r"^-(9{4,}(\.)?|9{3,}\.9+|9{1,3}\.?9{3,})0*$", r"^-((\d)\2{3,}(\.0+)?|([^36])\4{0,2}\.\4{3,}0*)$"]
SENTINEL_TEXT = r"^(-+|0+(\d)\2{3,}(\.0+)?|(.)\3{4,}0*)$"


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def plain_number(x: Column) -> Column:
    """A double as decimal text without exponent, one digit kept after the point."""
    wide = F.regexp_replace(x.try_cast("decimal(38,6)").cast("string"), r"(\.\d*?[1-9]|\.0)0*$", "$1")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), wide).otherwise(x.cast("string"))


def without_sentinels(name: str, kind: T.DataType) -> Column:
    """Sentinel values replaced: integers and texts by NULL, reals by the infinity of their sign."""
    x = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = plain_number(x.cast("double"))
        negative = (x < 0) & _any(text, SENTINEL_NEG)
        positive = (x >= 0) & _any(text, SENTINEL_POS)
        return (
            F.when(negative, F.lit(float("-inf")))
            .when(positive, F.lit(float("inf")))
            .when((x >= 0) & text.rlike(SENTINEL_TEXT), F.lit(None))
            .otherwise(x)
        )
    text = x.cast("string")
    if isinstance(kind, T.IntegralType):
        hit = ((x < 0) & _any(text, SENTINEL_NEG)) | ((x >= 0) & _any(text, [*SENTINEL_POS, SENTINEL_TEXT]))
    else:
        hit = _any(text, [*SENTINEL_POS, *SENTINEL_NEG, SENTINEL_TEXT])
    return F.when(~F.coalesce(hit, F.lit(False)), x)


def strip_quotes(text: Column) -> Column:
    return F.trim(F.btrim(text, F.lit("'")))


# Fixed value: what a number looks like.
NUMBER_TEXT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"


def read_number(text: Column) -> Column:
    """Double or NULL.  The shape is checked first: a failing cast costs far more than a pattern."""
    plain = F.trim(text)
    return F.when(plain.rlike(NUMBER_TEXT), plain.try_cast("double"))


def number_text(text: Column, na_texts: list[str] | None = None) -> tuple[Column, Column]:
    """(number, is_error) of raw text: quotes and spaces stripped, NA and infinity words understood."""
    value = F.coalesce(read_number(text), read_number(strip_quotes(text)))
    na = text.isin(na_texts if na_texts is not None else NA_TEXTS)
    number = (
        F.when(value.isNotNull(), value)
        .when(text.isin(INF_TEXTS), F.lit(float("inf")))
        .when(text.isin(NEG_INF_TEXTS), F.lit(float("-inf")))
    )
    return number, text.isNotNull() & number.isNull() & ~na


def european_number(text: Column, kind: str) -> Column:
    """Number from text with separators.

    ``real_sep``/``int_sep``: comma groups thousands; ``eu_real_sep``/``eu_int_sep``: dot groups, comma is decimal.
    """
    bare = F.regexp_replace(text, r"\s", "")
    if kind in ("real_sep", "int_sep"):
        number = F.regexp_replace(bare, ",", "")
    elif kind in ("eu_real_sep", "eu_int_sep"):
        number = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")
    else:
        raise ValueError(f"unknown separator kind {kind!r}")
    value = number.try_cast("double")
    return value if kind.endswith("real_sep") else F.when(F.floor(value) == value, value.try_cast("long"))


def repair_datetime(text: Column, year: int) -> Column:
    """``MM-DD``, ``YY/MM/DD`` and ``年月日時分秒`` texts in ISO order; ``year`` stands in where it is missing."""
    out = F.regexp_replace(text, r"^(\d{1,2})(?:-|/|月)(\d{1,2})日?$", f"{year}-$1-$2 00:00:00")
    date = r"(?:-|/|年)(\d{1,2})(?:-|/|月)(\d{1,2})日?$"
    out = F.regexp_replace(out, r"^(\d{4})" + date, "$1-$2-$3 00:00:00")
    out = F.regexp_replace(out, r"^(\d{1,2})" + date, f"{str(year)[:2]}$1-$2-$3 00:00:00")
    clock = r"^(\d{4})年(\d{1,2})月(\d{1,2})日(\d{1,2})時(\d{1,2})分(\d{1,2})秒$"
    return F.regexp_replace(out, clock, "$1-$2-$3 $4:$5:$6")


# Shapes of date and time texts.
DATE_TEXT = (
    r"^(\d{2}|\d{4})(?:[\-\.\s/\\年]?(\d|0\d|1[0-2])[月]?)(?:[\-\.\s/\\]?(\d|[0-2]\d|3[0-1])[日]?)?$"
)
TIME_TEXT = r"^(\d|[01]\d|2[0-3])(?:[:\-\.\s時]?(\d|[0-5]\d)[分]?)(?:[:\-\.\s]?(\d|[0-5]\d)[秒]?)?$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def repair_date(text: Column, century: str = "20") -> Column:
    """Dates in several notations as ``yyyy-MM-dd``; NULL when there is no such day."""
    year = _part(text, DATE_TEXT, 1)
    year = F.when(F.length(year) == 2, F.concat(F.lit(century), year)).otherwise(year)
    iso = F.concat_ws("-", year, F.lpad(_part(text, DATE_TEXT, 2), 2, "0"), F.lpad(_part(text, DATE_TEXT, 3), 2, "0"))
    return F.when(text.rlike(DATE_TEXT), F.date_format(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"))


def repair_time(text: Column) -> Column:
    """Times in several notations as ``HH:mm:ss``; NULL when unreadable."""
    parts = [F.lpad(_part(text, TIME_TEXT, i), 2, "0") for i in (1, 2)]
    second = _part(text, TIME_TEXT, 3)
    parts.append(F.when(second == "", F.lit("00")).otherwise(F.lpad(second, 2, "0")))
    return F.when(text.rlike(TIME_TEXT), F.concat_ws(":", *parts))


def date_time_text(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit("yyyy-MM-dd HH:mm:ss"))


# Circled digits stand for their number, postal marks for T.
CIRCLED = {
    "❶": "1", "❷": "2", "❸": "3", "❹": "4", "❺": "5", "❻": "6", "❼": "7", "❽": "8", "❾": "9", "❿": "10",
    "➀": "1", "➁": "2", "➂": "3", "➃": "4", "➄": "5", "➅": "6", "➆": "7", "➇": "8", "➈": "9", "➉": "10",
    "➊": "1", "➋": "2", "➌": "3", "➍": "4", "➎": "5", "➏": "6", "➐": "7", "➑": "8", "➒": "9", "➓": "10",
}
IRREGULAR = {**CIRCLED, "〒": "T", "〶": "T"}


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalise_text(text: Column, irregular: bool = True) -> Column:
    """NFKC form, single spaces, trimmed, degree signs unified, circled digits as numbers.

    Only texts with characters beyond ASCII go through Python.
    """
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    form = F.when(ascii_only, text).otherwise(_nfkc(F.when(~ascii_only, text)))
    spaced = F.btrim(F.regexp_replace(form, r"(?U)\s+", " "))
    out = F.replace(F.replace(spaced, F.lit("°C"), F.lit("℃")), F.lit("°F"), F.lit("℉"))
    if irregular:
        single = {k: v for k, v in IRREGULAR.items() if len(v) == 1}
        out = F.translate(out, "".join(single), "".join(single.values()))
        for mark in (k for k, v in IRREGULAR.items() if len(v) > 1):
            out = F.replace(out, F.lit(mark), F.lit(IRREGULAR[mark]))
    return out


def padded(x: Column, width: int, char: str = "0", left: bool = False) -> Column:
    """Text padded to at least ``width`` (never cut): on the left, or on the right with ``left=True``."""
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(
        F.rpad(text, width, char) if left else F.lpad(text, width, char)
    )


def with_coefficient(x: Column, operator: str, coefficient: str) -> Column:
    """The configured coefficient of a column: + - * / or a regex that keeps matching texts."""
    if operator == "regex":
        return F.when(x.rlike(coefficient), x)
    from millrace.functions.numeric import ratio

    value = float(coefficient)
    rules = {"+": lambda: x + value, "-": lambda: x - value, "*": lambda: x * value, "/": lambda: ratio(x, F.lit(value))}
    return rules[operator]()
