"""The equation catalogue: derived columns by function id.

Inputs are cast to the type the function expects (``x_type``/``y_type``: real, int, text, bool, datetime) and the
result to its output type; text results that are empty become NULL.  All functions are native expressions.  Two
ids depend on row order (shift 80, fill 90/190) and live in :mod:`millrace.operators.derive`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numeric import INF, double, ratio
from millrace.functions.timefmt import format_time, parse_time

JOINER = "|"


@dataclass(frozen=True)
class EquationSpec:
    """One derived column: function id, input columns, output column and coefficients."""

    fn: int
    x: str
    y: str | None = None
    out: str | None = None
    x_type: str = "real"
    y_type: str = "real"
    a: float | None = None
    b: float | None = None
    c: float | None = None
    n: int | None = None
    k: int | None = None
    s: str | None = None
    t: str | None = None

    def num(self, name: str, default: float) -> float:
        value = getattr(self, name)
        return float(default if value is None else value)


SPARK_TYPES = {"real": "double", "int": "long", "text": "string", "bool": "boolean", "datetime": "timestamp"}


def to_type(col: Column, kind: str) -> Column:
    return col if kind == "any" else col.try_cast(SPARK_TYPES[kind])


def null_if_empty(col: Column) -> Column:
    return F.when(col != "", col)


def convert(col: Column, t: str | None, source: str = "text") -> Column:
    """Forced conversion to Real, Int, Str or Cat; what does not convert is NULL."""
    kind = (t or {"real": "Real", "int": "Int"}.get(source, "Str")).strip()
    if kind not in ("Real", "Int", "Str", "Cat"):
        raise ValueError(f"t must be one of Real, Int, Str, Cat, not {t!r}")
    if source == "bool":
        if kind == "Real":
            return col.cast("int").cast("double")
        return col.cast("long") if kind == "Int" else col.cast("string")
    if kind == "Real":
        return col.try_cast("double")
    if kind == "Int":
        if source == "int":
            return col.try_cast("long")
        value = col.try_cast("double")
        exact = col.try_cast("long") if source == "text" else value.try_cast("long")
        whole = F.when(F.floor(value) == value, F.coalesce(exact, value.try_cast("long")))
        return whole
    return null_if_empty(col.cast("string"))


def constant(text: str, kind: str):
    """A text coefficient as the Python value comparable with a column of this kind."""
    if kind == "bool" and text.lower() in ("true", "false", "1", "0"):
        return text.lower() in ("true", "1")
    order = {"real": [float], "int": [int, float], "text": [str]}.get(kind, [int, float])
    for typ in [*order, str]:
        try:
            return typ(text)
        except ValueError:
            continue
    return text


def _linear(p, x, y):
    return p.num("a", 1) * x + p.num("c", 0)


def _combination(p, x, y):
    return p.num("a", 1) * x + p.num("b", 1) * y + p.num("c", 0)


def _product(p, x, y):
    return p.num("a", 1) * x * y + p.num("c", 0)


def _ratio(p, x, y):
    return ratio(p.num("a", 1) * x, p.num("b", 1) * y) + p.num("c", 0)


def _exponent(p, x, y):
    return p.num("a", 1) * x * F.pow(F.lit(10.0), y - p.num("b", 0)) + p.num("c", 0)


def _power(p, x, y):
    return p.num("a", 1) * F.pow(x, F.lit(p.num("b", 2))) + p.num("c", 0)


def _log10(p, x, y):
    arg = x - p.num("b", 0)
    a, c = p.num("a", 1), p.num("c", 0)
    return F.when(arg == 0, F.lit(a) * F.lit(-INF) + c).when(arg > 0, a * F.log10(arg) + c)


# Fixed value: what a base-16 integer literal may look like.
HEX_TEXT = r"^\s*[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*\s*$"


def _hex_parts(x: Column) -> tuple[Column, Column, Column]:
    ok = x.rlike(HEX_TEXT)
    digits = F.regexp_replace(F.regexp_replace(F.trim(x), r"^[+-]?(0[xX])?", ""), "_", "")
    return ok, F.trim(x).startswith("-"), digits


def hex_value(x: Column) -> Column:
    ok, negative, digits = _hex_parts(x)
    value = F.conv(digits, 16, 10).try_cast("long")
    return F.when(ok, F.when(negative, -value).otherwise(value))


def _hex_to_int(p, x, y):
    return hex_value(x)


def _hex_to_bin(p, x, y):
    ok, negative, digits = _hex_parts(x)
    bits = F.conv(digits, 16, 2)
    return F.when(ok, F.when(negative & (bits != "0"), F.concat(F.lit("b"), bits)).otherwise(bits))


def _hex_bit(p, x, y):
    return hex_value(x).bitwiseAND(F.lit(1 << (int(p.n or 1) - 1)).cast("long")) != 0


def _radius(p, x, y):
    dx, dy = x - p.num("a", 0), y - p.num("b", 0)
    return ratio(F.sqrt(dx * dx + dy * dy), F.lit(p.num("c", 1)))


def _angle(p, x, y):
    return F.degrees(F.atan2(y - p.num("b", 0), x - p.num("a", 0))) - p.num("c", 0)


def python_slice(x: Column, start: int, stop: int | None) -> Column:
    """x[start:stop] with Python's rules for negative positions."""
    size = F.length(x)

    def place(i: int | None) -> Column:
        if i is None:
            return size
        return F.least(F.lit(i), size) if i >= 0 else F.greatest(size + i, F.lit(0))

    lo, hi = place(start), place(stop)
    return F.substring(x, lo + 1, F.greatest(hi - lo, F.lit(0)))


def _substring(p, x, y):
    n, k = int(1 if p.n is None else p.n), int(-2 if p.k is None else p.k)
    start = n - 1 if n > 0 else n
    stop = None if k == -1 else (k + 1 if k < 0 else k)
    return convert(python_slice(x, start, stop), p.t or "Str")


def _cell(value: Column, spec: str, kind: str) -> tuple[Column, bool]:
    """One formatted replacement field and whether it needs a number."""
    if spec == "":
        text = value.cast("string")
        return F.coalesce(text, F.lit("")), False
    if not re.fullmatch(r"[+ ]?0?\d*(\.\d+)?[dfexX]", spec) or kind == "text":
        return F.lit(None).cast("string"), True
    if spec.endswith("d") and kind == "real":
        return F.lit(None).cast("string"), True
    typed = value if not spec[-1] in "fe" else value.cast("double")
    return F.format_string("%" + spec, typed), True


def _combine_text(p, x, y):
    template = p.s if p.s is not None else "Eq{:02d}-St{:01d}"
    fields = re.findall(r"\{[^{}]*\}", template)
    if len(fields) != 2:
        raise ValueError("s must have two fields, one for X and one for Y")
    literals = re.split(r"\{[^{}]*\}", template)
    parts, guards = [F.lit(literals[0])], []
    for value, kind, field, tail in zip((x, y), (p.x_type, p.y_type), fields, literals[1:]):
        text, needs_value = _cell(value, field[1:-1].lstrip(":"), kind)
        parts += [text, F.lit(tail)]
        if needs_value:
            guards.append(value.isNotNull())
    joined = F.concat(*parts)
    if guards:
        joined = F.when(reduce(lambda l, r: l & r, guards), joined)
    return convert(joined, p.t or "Str")


def _parse(p, x, y):
    return parse_time(x, p.s or "%Y%m%d%H%M%S.%f")


def _date_time(p, x, y, zone: str = "UTC"):
    date_fmt, time_fmt = p.s or "%Y%m%d", p.t or "%H:%M:%S.%f"
    day = x if p.x_type != "datetime" else format_time(x, date_fmt)
    clock = y if p.y_type != "datetime" else format_time(y, time_fmt)
    local = parse_time(F.concat(day, clock), date_fmt + time_fmt)
    return F.to_utc_timestamp(local, zone)


def _format(p, x, y):
    """Text form; with ``t='Int'`` a long.  The whole-column choice is made in ``apply_equations``."""
    text = format_time(x, p.s or "%Y%m%d%H%M%S.%f")
    return text.try_cast("long") if p.t == "Int" else text


def frame_labels(a: float, b: float) -> list[tuple[float, float, str]]:
    """(low, high, label) minute bins of a day that starts at hour ``a`` in steps of ``b`` hours."""
    if not 0 <= a < 24 or not 0.5 <= b < 24:
        raise ValueError("a must be in [0, 24) and b in [0.5, 24)")
    edges = [a * 60]
    while edges[-1] + b * 60 < a * 60 + 1440:
        edges.append(edges[-1] + b * 60)
    edges.append(a * 60 + 1440)

    def clock(minute: float) -> str:
        return f"{int(minute) // 60:02d}:{int(minute) % 60:02d}"

    bins = []
    for lo, hi in zip(edges, edges[1:]):
        back = 1440 if lo > 1440 else 0
        bins.append((lo, hi, f"{clock(lo - back)}-{clock(hi - back)}"))
    return bins


def _time_frame(p, x, y, closed: str = "right"):
    """Bins are right-closed, so the very first minute of the day frame has no label (``closed='left'`` mends it)."""
    a, b = p.num("a", 9.5), p.num("b", 8)
    minute = F.hour(x) * 60 + F.minute(x)
    minute = F.when(minute < a * 60, minute + 1440).otherwise(minute)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(frame_labels(a, b)):
        inside = (minute > lo) & (minute <= hi) if closed == "right" else (minute >= lo) & (minute < hi)
        out = F.when(inside, label).otherwise(out)
    return out


# Weekday names from Monday, by style.
WEEKDAYS = {
    0: ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"],
    1: ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
    2: ["月", "火", "水", "木", "金", "土", "日"],
    3: ["月曜日", "火曜日", "水曜日", "木曜日", "金曜日", "土曜日", "日曜日"],
}


def _weekday(p, x, y):
    names = F.array(*[F.lit(w) for w in WEEKDAYS[int(p.n or 0)]])
    return F.get(names, F.weekday(x))


def _week(p, x, y):
    return F.weekofyear(x)


def _day(p, x, y):
    return F.dayofmonth(x)


def _month(p, x, y):
    return F.month(x)


def _year(p, x, y):
    return F.year(x) if int(p.n or 0) == 0 else F.year(x) % 100


def _equal(p, x, y):
    """Several values are OR-ed, also for ``!=`` (then any known value passes when two values are given)."""
    sign = (p.t or "==").strip()
    if sign not in ("==", "!="):
        raise ValueError("t must be == or !=")
    tests = []
    for text in (p.s or "1").split(JOINER):
        value = F.lit(constant(text, p.x_type))
        tests.append(x == value if sign == "==" else x != value)
    return reduce(lambda l, r: l | r, tests)


def _compare(p, x, y):
    value = F.lit(constant(p.s or "1", p.x_type))
    tests = {">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value}
    return tests[(p.t or ">").strip()]


def _both_known(x, y, result):
    return F.when(x.isNotNull() & y.isNotNull(), result)


def _or(p, x, y):
    return _both_known(x, y, x | y)


def _and(p, x, y):
    return _both_known(x, y, x & y)


def java_regex(pattern: str) -> str:
    """Python pattern in Java's dialect: named groups and named back-references differ."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern))


def java_replacement(text: str) -> str:
    escaped = text.replace("$", r"\$")
    return re.sub(r"\\(?:g<(\d+)>|(\d+))", lambda m: "${}".format(m.group(1) or m.group(2)), escaped)


def _extract(p, x, y):
    pattern = p.s or r"(?<=E[Qq][-\.]?)\d(?=S[Tt])"
    groups = re.compile(re.sub(r"\(\?<[=!][^)]*\)", "", pattern)).groups
    java = F.lit(java_regex(pattern if groups else f"({pattern})"))
    found = [F.regexp_extract(x, java_regex(pattern if groups else f"({pattern})"), g) for g in range(1, max(groups, 1) + 1)]
    text = F.when(F.rlike(x, java), F.concat_ws(JOINER, *found))
    return convert(text, "Str" if groups > 1 else p.t, p.x_type if not p.t else "text")


def _remove(p, x, y):
    out = x
    for pattern in (p.s if p.s is not None else r"Line|Eq\d{2}St\d").split(JOINER):
        out = F.regexp_replace(out, java_regex(pattern), "")
    if p.t:
        return convert(out, p.t)
    return convert(out, {"real": "Real", "int": "Int"}.get(p.x_type, "Str"))


def _replace(p, x, y):
    return F.regexp_replace(x, java_regex(p.s or "[Ss][Tt]"), java_replacement(p.t if p.t is not None else "St"))


def _merge(p, x, y):
    if p.x_type != p.y_type:
        raise ValueError("X and Y must have the same type")
    if p.x_type == "text":
        x, y = null_if_empty(x), null_if_empty(y)
    return convert(F.coalesce(x, y), p.t or "Real", p.x_type)


def _lookup(p, x, y):
    old, new = (p.s or "1|2").split(JOINER), (p.t or "OK|NG").split(JOINER)
    if len(old) != len(new):
        raise ValueError("s and t must have the same number of values")
    table = dict(zip(old, new))
    if p.x_type == "bool":
        yes, no = table.get("true"), table.get("false")
        return F.when(x, F.lit(yes)).when(~x, F.lit(no))
    out = x
    for value, replacement in reversed(list(table.items())):
        out = F.when(x == value, F.lit(replacement)).otherwise(out)
    return out


def _convert_type(p, x, y):
    return convert(x, p.t or "Int", p.x_type)


def _remove_numbers(p, x, y):
    hits = [x == float(v) for v in (p.a, p.b, p.c) if v is not None]
    return F.when(~F.coalesce(reduce(lambda l, r: l | r, hits), F.lit(False)), x)


def _remove_range(p, x, y):
    return F.when(~((x >= p.num("a", -INF)) & (x <= p.num("b", 0))), x)


def _pass_range(p, x, y):
    return F.when(~((x < p.num("a", 0)) | (x > p.num("b", INF))), x)


def _remove_text(p, x, y):
    return convert(F.when(x != F.lit(p.s if p.s is not None else "NA"), x), p.t or "Str")


Rule = Callable[[EquationSpec, Column, Column | None], Column]

# id: (rule, type X is read as, type Y is read as); "own" keeps the type named in the spec.
CATALOGUE: dict[int, tuple[Rule, str, str | None]] = {
    10: (_linear, "real", None),
    11: (_combination, "real", "real"),
    12: (_product, "real", "real"),
    13: (_ratio, "real", "real"),
    14: (_exponent, "real", "real"),
    15: (_power, "real", None),
    16: (_log10, "real", None),
    20: (_hex_to_int, "text", None),
    21: (_hex_to_bin, "text", None),
    22: (_hex_bit, "text", None),
    28: (_radius, "real", "real"),
    29: (_angle, "real", "real"),
    30: (_substring, "text", None),
    32: (_combine_text, "own", "own"),
    40: (_parse, "text", None),
    41: (_date_time, "own", "own"),
    42: (_format, "datetime", None),
    43: (_time_frame, "datetime", None),
    44: (_weekday, "datetime", None),
    45: (_week, "datetime", None),
    46: (_day, "datetime", None),
    47: (_month, "datetime", None),
    48: (_year, "datetime", None),
    50: (_equal, "own", None),
    51: (_compare, "own", None),
    55: (_or, "bool", "bool"),
    56: (_and, "bool", "bool"),
    60: (_extract, "text", None),
    61: (_remove, "text", None),
    62: (_replace, "text", None),
    70: (_merge, "own", "own"),
    71: (_lookup, "text", None),
    72: (_convert_type, "own", None),
    120: (_remove_numbers, "own", None),
    121: (_remove_range, "own", None),
    122: (_pass_range, "own", None),
    131: (_remove_text, "text", None),
}

# Ids that overwrite their own column share the rule of the plain id.
SELF_IDS = {130: 30, 160: 60, 161: 61, 162: 62, 170: 70, 171: 71, 172: 72, 190: 90}
ORDERED_IDS = (80, 90)


def base_id(fn: int) -> int:
    return SELF_IDS.get(fn, fn)


def overwrites_input(fn: int) -> bool:
    return fn >= 120


def evaluate(p: EquationSpec) -> Column:
    """The derived column of one spec (for ids that do not depend on row order)."""
    rule, x_kind, y_kind = CATALOGUE[base_id(p.fn)]
    if base_id(p.fn) == 71 and p.x_type == "bool":
        x_kind = "bool"
    x = to_type(F.col(p.x), p.x_type if x_kind == "own" else x_kind)
    y = None
    if y_kind is not None:
        if p.y is None:
            raise ValueError(f"function {p.fn} needs Y")
        y = to_type(F.col(p.y), p.y_type if y_kind == "own" else y_kind)
    return rule(p, x, y)
