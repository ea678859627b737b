"""Rules that take master names apart: data names, lines, equipment, parts, processes.

Each rule is an ordered list of patterns; the first that matches gives the parts, and a fallback keeps the name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Escapes removed from names, brackets unified, prefixes dropped, unit spellings.
ESCAPES = r"\\+[nrt]"
DATA_ESCAPES = r"\\+[nrt]|\(?±\)?"
OPEN_BRACKETS = r"\s?[(\[【「『〖〚〘｟〔]\s?"
CLOSE_BRACKETS = r"\s?[)\]】」』〗〛〙｠〕]\s?"
DATA_PREFIXES = ["計測値:", "加工値:", "加工条件:", "加工条件値:", "その他:", "measurement.", "測定値:", "OK/NG情報:"]
UNIT_SPELLINGS = {"μ": "µ", "KPa": "kPa", "cm^3/min": "cm3/min"}

# Patterns of names, tried in order.
DATA_NAME = [
    r"^([^\[\]]*)[\[\s]*([^\[\]]*)[\]\s]*([^\[\]]*)$",
    r"^([^\[\]]+)[\[\s]*([^\[\]]*)[\]\s]*[\[\s]*([^\[\]]*)[\]\s]*([^\[\]]*)$",
]
LINE_NAMES = [
    (r"\s(.+\D)()(\d+)号ライン$", (1, 3, 2)),
    (r"\s(.+\D)()(\d+)号$", (1, 3, 2)),
    (r"\s(.+)(CKD)(\d+)号ライン$", (1, 3, 2)),
    (r"(\d+)号\s(.+)ライン$", (2, 1, None)),
    (r"()\s(.+)ライン$", (2, 1, None)),
    (r"(.+\D)()(\d+)号$", (1, 3, 2)),
    (r"(.+)(CKD)(\d+)号ライン$", (1, 3, 2)),
]
EQUIP_NAMES = [
    r"^(.*[^\d機])機?(\d+)号機?()$",
    r"^(.*[^\d機])機?(\d+)号機?(\d+)[sS][tT]$",
    r"^(.+)()機()$",
    r"^(.*[^\d機])機?()\s?(\d+)[sS][tT]$",
]
EQUIP_IDS = [
    r"^([a-zA-Z]{2,4})[-_]{0,}([\d_]{4})[-_]{0,}(\d{1,2})?$",
    r"^.*_([a-zA-Z]{2,4})[-_]{0,}([\d_]{4})[-_]{0,}(\d{1,2})?$",
]
PART_NUMBER = r"^([A-Z]{2})(\d{6})(\d{3})(\d{1})$"
SHORT_PART = r"^\d{3}$"
PROCESS_NAMES = [r"^(.*[^\d機])機?(\d+)号機?$", r"^(.*)()機$"]


def _clean(name: Column) -> Column:
    return F.regexp_replace(name, ESCAPES, "")


def _blank(text: Column) -> Column:
    return F.when(text != "", text)


def _rules(text: Column, branches: list[tuple[str, Column]], fallback: Column) -> Column:
    out = F.lit(None)
    first, *rest = branches
    out = F.when(text.rlike(first[0]), first[1])
    for pattern, value in rest:
        out = out.when(text.rlike(pattern), value)
    return out.otherwise(fallback)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def spelled_unit(unit: Column) -> Column:
    for old, new in UNIT_SPELLINGS.items():
        unit = F.replace(unit, F.lit(old), F.lit(new))
    return F.trim(unit)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def data_name(name: Column, units: Sequence[str] = ()) -> Column:
    """struct(name, unit) of ``name[unit]suffix``; a known unit in round brackets counts as well."""
    known = F.array(*[F.lit(u) for u in units]) if units else F.array().cast("array<string>")
    one, two = DATA_NAME

    def joined(text: Column, pattern: str, tail: int) -> Column:
        head, suffix = F.trim(_part(text, pattern, 1)), _part(text, pattern, tail)
        label = bound(suffix, lambda s: F.when(s != "", F.concat(head, F.lit(" "), s)).otherwise(head))
        return F.struct(label.alias("label"), _blank(spelled_unit(_part(text, pattern, 2))).alias("unit"))

    def split(text: Column) -> Column:
        return F.when(text.rlike(one), joined(text, one, 3)).when(text.rlike(two), joined(text, two, 4))

    def brackets(parts: Column) -> Column:
        round_only = F.regexp_replace(F.regexp_replace(parts["label"], OPEN_BRACKETS, "("), CLOSE_BRACKETS, ")")
        return F.struct(round_only.alias("label"), parts["unit"].alias("unit"))

    def assumed(parts: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(parts["label"], F.lit(r"\((.*?)\)"), F.lit(1)), lambda u: F.trim(u))
        hit = F.get(F.filter(inner, lambda u: (u != "") & F.array_contains(known, spelled_unit(u))), 0)
        found = F.when(parts["unit"].isNull() & parts["label"].contains("("), hit)
        return F.struct(parts["label"].alias("label"), parts["unit"].alias("unit"), found.alias("found"))

    def finished(parts: Column) -> Column:
        escaped = F.concat(F.lit(r"\s?\(\s?\Q"), parts["found"], F.lit(r"\E\s?\)\s?"))
        label = F.when(parts["found"].isNull(), parts["label"]).otherwise(
            F.regexp_replace(parts["label"], escaped, F.lit(""))
        )
        label = F.regexp_replace(F.regexp_replace(label, r"[()]", " "), r"\s+", " ")
        label = F.replace(F.replace(label, F.lit("No."), F.lit("No")), F.lit(";"), F.lit(":"))
        for prefix in DATA_PREFIXES:
            label = F.replace(label, F.lit(prefix), F.lit(""))
        return F.struct(F.trim(label).alias("name"), F.coalesce(parts["unit"], spelled_unit(parts["found"])).alias("unit"))

    def parsed(text: Column) -> Column:
        plain = F.struct(text.alias("name"), F.lit(None).cast("string").alias("unit"))
        known_shape = bound(split(text), lambda p: F.when(p.isNotNull(), bound(brackets(p), lambda b: bound(assumed(b), finished))))
        return F.coalesce(known_shape, plain)

    return F.when(name.isNotNull(), bound(F.regexp_replace(name, DATA_ESCAPES, ""), parsed))


# Line names that begin with a product, in the order in which they are tried; groups: product, line, number.
PRODUCT_LINES = [r".*(GD-P4|P4H)\s(.*\D)(\d*)号ライン$", r".*(GD-P4|P4H)\s(.*)()ライン$", r".*(GD-P4|P4H)\s(.*)()$"]


def product_line(name: Column) -> Column:
    """struct(product, line, line_no, outsourced): the product patterns first, then ``line_name`` without a product."""
    text = _clean(name)

    def parts(pattern: str) -> Column:
        return F.struct(
            _part(text, pattern, 1).alias("product"),
            F.trim(_part(text, pattern, 2)).alias("line"),
            _blank(_part(text, pattern, 3)).alias("line_no"),
            F.lit(False).alias("outsourced"),
        )

    plain = line_name(name)
    rest = F.struct(F.lit(None).cast("string").alias("product"), *[plain[c].alias(c) for c in ("line", "line_no", "outsourced")])
    return _rules(text, [(p, parts(p)) for p in PRODUCT_LINES], rest)


def line_name(name: Column) -> Column:
    """struct(line, line_no, outsourced); names of no known shape stay as they are."""
    text = _clean(name)

    def parts(pattern: str, groups: tuple) -> Column:
        label, number, ckd = groups
        return F.struct(
            F.trim(_part(text, pattern, label)).alias("line"),
            _blank(_part(text, pattern, number)).alias("line_no"),
            (F.lit(False) if ckd is None else _part(text, pattern, ckd) != "").alias("outsourced"),
        )

    fallback = F.struct(text.alias("line"), F.lit(None).cast("string").alias("line_no"), F.lit(False).alias("outsourced"))
    return _rules(text, [(p, parts(p, g)) for p, g in LINE_NAMES], fallback)


def equipment_name(name: Column) -> Column:
    """struct(equip, equip_no, st_no)."""
    text = _clean(name)
    branches = [
        (p, F.struct(_part(text, p, 1).alias("equip"), _blank(_part(text, p, 2)).alias("equip_no"), _blank(_part(text, p, 3)).alias("st_no")))
        for p in EQUIP_NAMES
    ]
    empty = F.lit(None).cast("string")
    return _rules(text, branches, F.struct(text.alias("equip"), empty.alias("equip_no"), empty.alias("st_no")))


def equipment_id(name: Column) -> Column:
    """struct(equip_id, station): letters filled with X and digits with 0 to four, as ``AAAA-0000``."""
    text = _clean(name)

    def parts(p: str) -> Column:
        code = F.concat(F.rpad(_part(text, p, 1), 4, "X"), F.lit("-"), F.lpad(_part(text, p, 2), 4, "0"))
        return F.struct(code.alias("equip_id"), _blank(_part(text, p, 3)).try_cast("int").alias("station"))

    return _rules(text, [(p, parts(p)) for p in EQUIP_IDS], F.struct(text.alias("equip_id"), F.lit(None).cast("int").alias("station")))


def part_number(name: Column) -> Column:
    """struct(full, part_type, part_no, location) of twelve-character, three-digit or other part numbers."""
    text = F.replace(_clean(name), F.lit(" "), F.lit("0"))
    short = F.concat(F.lit("JP000000"), text, F.lit("0"))
    size = F.length(text)
    jp = F.when(size >= 12, text).otherwise(F.rpad(text, 12, "0"))
    other = F.concat(F.lit("JP"), F.when(size >= 9, text).otherwise(F.lpad(text, 9, "0")), F.lit("0"))
    full = F.when(text.rlike(PART_NUMBER), text).when(text.rlike(SHORT_PART), short)
    full = full.when(text.startswith("JP"), jp).otherwise(other)
    return F.struct(
        full.alias("full"),
        F.substring(full, 3, 6).alias("part_type"),
        F.substring(full, 9, 3).alias("part_no"),
        F.substring(full, 1, 2).alias("location"),
    )


def process_name(name: Column) -> Column:
    text = _clean(name)
    return _rules(text, [(p, _part(text, p, 1)) for p in PROCESS_NAMES], text)


def data_id(name: Column, history: bool = False) -> Column:
    """The data id as given, or in history sources its last five characters."""
    text = _clean(name)
    return F.when(F.length(text) >= 5, F.substring(text, -5, 5)).otherwise(text) if history else name


def unit_name(name: Column) -> Column:
    return F.trim(_clean(name))


def replaced_words(text: Column, words: dict[str, str]) -> Column:
    """Whole values exchanged by a word list."""
    out = text
    for old, new in words.items():
        out = F.when(text == old, F.lit(new)).otherwise(out)
    return out


# Symbols of names and their spelling in system names.
SYMBOLS = [
    (r"[〒〠〶]", "post"),
    (r"[μµ]", "u"),
    (r"[\(\)\[\]<>\{\}【】]", "_"),
    (r"-+", "-"),
    (r"_+", "_"),
    (r"^[_-]", ""),
    (r"[_-]$", ""),
    (r"[℃°]", "deg"),
    (r"℉", "degF"),
    (r"%", "pct"),
    (r"[Δ△]", "d"),
    (r"Ω", "ohm"),
    (r"Uu|uu", "u"),
    (r"Mm", "mm"),
]
DROPPED = r"[\s\t\+\*…・:;!\?\$\&\"'`\=\@\#\\/。、\.,~\|]"

# Katakana syllables in table order, per vowel row.
KANA_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ",
    "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ",
    "p": "パピプペポ",
}
KANA_EXTRA = {"ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヲ": "wo", "ン": "n", "ー": "",
              "シ": "shi", "チ": "chi", "ツ": "tsu", "フ": "fu", "ジ": "ji", "ヂ": "ji", "ヅ": "zu"}


def kana_table() -> dict[str, str]:
    """Katakana and hiragana syllables with their Latin spelling."""
    table = {c: row + vowel for row, kana in KANA_ROWS.items() for c, vowel in zip(kana, "aiueo")}
    table.update(KANA_EXTRA)
    return {**table, **{chr(ord(c) - 0x60): v for c, v in table.items() if c != "ー"}}


def _fold(text: str) -> str:
    text = "".join(KANA.get(c, c) for c in unicodedata.normalize("NFKC", text))
    parts = (unicodedata.normalize("NFD", c) for c in text)
    return "".join(p[0] if p[0].isascii() else unicodedata.normalize("NFC", p) for p in parts)


KANA = kana_table()


@F.pandas_udf(T.StringType())
def _latin(texts: pd.Series) -> pd.Series:
    return texts.map(_fold, na_action="ignore")


def system_name(name: Column) -> Column:
    """ASCII system name: symbols spelled out, kana in Latin letters, accents folded; other scripts are kept.

    Kanji have no reading here (that needs a dictionary), so they stay in the name.
    """
    text = F.regexp_replace(name, *SYMBOLS[0])
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    for pattern, spelling in SYMBOLS[1:]:
        text = F.regexp_replace(text, pattern, spelling)
    text = F.when(ascii_only, text).otherwise(_latin(F.when(~ascii_only, text)))
    return F.regexp_replace(text, DROPPED, "")


def converted_unit(value: Column, conversion: Column, denominator: Column, offset: Column) -> Column:
    """Value in its base unit: value × conversion / denominator + offset."""
    return F.try_divide(value * conversion, denominator) + offset
