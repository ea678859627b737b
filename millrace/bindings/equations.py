"""F10-F131: one query per catalogue function."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, rnd
from millrace.functions.equations import EquationSpec
from millrace.operators.derive import apply_equations

R = Registry()

LINE = ["l_orderkey", "l_linenumber"]


def _on_lineitem(name, spec, sql_expr, digits=None, where=""):
    def build(t):
        out = apply_equations(t.lineitem, [spec]).select(*LINE, "r")
        return out.withColumn("r", rnd("r", digits)) if digits is not None else out

    expr = f"round({sql_expr}, {digits})" if digits is not None else sql_expr
    R.add(name, build, f"select l_orderkey, l_linenumber, {expr} as r from lineitem {where}")


def _on(name, table, key, spec, sql_expr, prepare=None, digits=None, source=None):
    def build(t):
        df = getattr(t, table)
        df = prepare(df) if prepare else df
        out = apply_equations(df, [spec]).select(key, "r")
        return out.withColumn("r", rnd("r", digits)) if digits is not None else out

    expr = f"round({sql_expr}, {digits})" if digits is not None else sql_expr
    R.add(name, build, f"select {key}, {expr} as r from {source or table}")


E = EquationSpec
_on_lineitem("F10_linear", E(10, "l_quantity", out="r", a=2.5, c=-1), "2.5*l_quantity - 1", 6)
_on_lineitem("F11_combination", E(11, "l_quantity", "l_tax", "r", a=2, b=3, c=1), "2*l_quantity + 3*l_tax + 1", 6)
_on_lineitem("F12_product", E(12, "l_extendedprice", "l_discount", "r", a=2, c=3), "2*l_extendedprice*l_discount + 3", 6)
_on_lineitem(
    "F13_ratio",
    E(13, "l_tax", "l_discount", "r", a=1, b=2, c=0.5),
    "case when l_discount = 0 then (case when l_tax = 0 then null else 'inf'::double end)"
    " else l_tax/(2*l_discount) + 0.5 end",
    6,
)
_on_lineitem("F14_exponent", E(14, "l_quantity", "l_tax", "r", a=1.5, b=1, c=2), "1.5*l_quantity*pow(10.0, l_tax-1)+2", 6)
_on_lineitem("F15_power", E(15, "l_quantity", out="r", a=2, b=0.5, c=1), "2*pow(l_quantity, 0.5)+1", 6)
_on_lineitem(
    "F16_log10",
    E(16, "l_quantity", out="r", a=3, b=2, c=1),
    "case when l_quantity < 2 then null when l_quantity = 2 then '-inf'::double"
    " else 3*log10(case when l_quantity > 2 then l_quantity - 2 else 1 end)+1 end",
    6,
)


def _hexed(df):
    return df.withColumn(
        "h", F.when(F.col("user_id") % 10 == 0, F.lit("zz")).otherwise(F.lower(F.hex(F.col("event_id") * 7919)))
    )


HEX_SRC = "(select event_id, user_id, case when user_id % 10 = 0 then null else event_id*7919 end as n from events) s"
_on("F20_hex_to_int", "events", "event_id", E(20, "h", out="r"), "n", _hexed, source=HEX_SRC)
_on(
    "F21_hex_to_bin",
    "events",
    "event_id",
    E(21, "h", out="r"),
    "case when n is null then null when n = 0 then '0' else ltrim(bin(n), '0') end",
    _hexed,
    source=HEX_SRC,
)
_on("F22_hex_bit", "events", "event_id", E(22, "h", out="r", n=4), "(n & 8) <> 0", _hexed, source=HEX_SRC)
_on_lineitem(
    "F28_radius",
    E(28, "l_quantity", "l_linenumber", "r", a=10, b=3, c=2),
    "sqrt(pow(l_quantity-10,2)+pow(l_linenumber-3,2))/2",
    6,
)
_on_lineitem(
    "F29_angle",
    E(29, "l_quantity", "l_linenumber", "r", a=10, b=3, c=15),
    "degrees(atan2(l_linenumber::double-3, l_quantity-10)) - 15",
    6,
)
_on("F30_substring", "part", "p_partkey", E(30, "p_name", out="r", n=2, k=5), "nullif(substr(p_name,2,4),'')")
_on(
    "F30_substring_from_end",
    "part",
    "p_partkey",
    E(30, "p_name", out="r", n=-3, k=-2),
    "nullif(substr(p_name, length(p_name)-2, 2),'')",
)
_on("F130_substring_self", "part", "p_partkey", E(130, "p_type", out="r", n=1, k=3), "substr(p_type,1,3)")
_on(
    "F32_format_combine",
    "part",
    "p_partkey",
    E(32, "p_size", "p_brand", "r", x_type="int", y_type="text", s="S{:03d}-{}", t="Str"),
    "'S' || lpad(p_size::varchar, 3, '0') || '-' || p_brand",
)


def _texted(df):
    return df.withColumn("txt", F.date_format("ts", "yyyyMMddHHmmss.SSSSSS")).withColumn(
        "txt", F.when(F.col("event_type") == "error", F.lit("bad")).otherwise(F.col("txt"))
    )


_on(
    "F40_parse_datetime",
    "events",
    "event_id",
    E(40, "txt", out="r", s="%Y%m%d%H%M%S.%f"),
    "case when event_type = 'error' then null else ts end",
    _texted,
)


def _date_and_time(df):
    return df.withColumn("d", F.date_format("ts", "yyyyMMdd")).withColumn("h", F.date_format("ts", "HH:mm:ss.SSSSSS"))


_on(
    "F41_date_and_time",
    "events",
    "event_id",
    E(41, "d", "h", "r", x_type="text", y_type="text"),
    "ts",
    _date_and_time,
)
_on("F42_format_datetime", "events", "event_id", E(42, "ts", out="r", s="%Y-%m-%d %H"), "strftime(ts, '%Y-%m-%d %H')")
_on("F42_format_datetime_int", "events", "event_id", E(42, "ts", out="r", s="%Y%m%d"), "strftime(ts, '%Y%m%d')::bigint")
_on("F42_format_sunday_week", "events", "event_id", E(42, "ts", out="r", s="w%U"), "strftime(ts, 'w%U')")
_on(
    "F43_time_frame",
    "events",
    "event_id",
    E(43, "ts", out="r", a=9.5, b=8),
    "case when m > 570 and m <= 1050 then '09:30-17:30' when m > 1050 and m <= 1530 then '17:30-25:30'"
    " when m > 1530 and m <= 2010 then '01:30-09:30' end",
    source="(select event_id, case when h < 570 then h + 1440 else h end as m from"
    " (select event_id, hour(ts)*60+minute(ts) as h from events)) s",
)
_on("F44_weekday", "events", "event_id", E(44, "ts", out="r", n=1), "dayname(ts)")
_on(
    "F44_weekday_jp",
    "events",
    "event_id",
    E(44, "ts", out="r", n=2),
    "(['月','火','水','木','金','土','日'])[isodow(ts)]",
)
_on("F45_iso_week", "orders", "o_orderkey", E(45, "o_orderdate", out="r"), "weekofyear(o_orderdate)::int")
_on("F46_day", "orders", "o_orderkey", E(46, "o_orderdate", out="r"), "day(o_orderdate)::int")
_on("F47_month", "orders", "o_orderkey", E(47, "o_orderdate", out="r"), "month(o_orderdate)::int")
_on("F48_year", "orders", "o_orderkey", E(48, "o_orderdate", out="r", n=1), "(year(o_orderdate) % 100)::int")
_on_lineitem("F50_equal", E(50, "l_quantity", out="r", s="1|25|3", t="=="), "l_quantity in (1,25,3)")
_on(
    "F50_not_equal_text",
    "events",
    "event_id",
    E(50, "event_type", out="r", x_type="text", s="click|view", t="!="),
    "event_type <> 'click' or event_type <> 'view'",
)
_on_lineitem("F51_compare", E(51, "l_quantity", out="r", s="24.5", t=">="), "l_quantity >= 24.5")


def _flags(df):
    return df.withColumn("x", F.when(F.col("value") > 10, F.col("value") > 50)).withColumn(
        "y", F.when(F.col("event_type") != "view", F.col("user_id") % 2 == 0)
    )


FLAG_SRC = (
    "(select event_id, case when value > 10 then value > 50 end as x,"
    " case when event_type <> 'view' then user_id % 2 = 0 end as y from events) s"
)
_on(
    "F55_or",
    "events",
    "event_id",
    E(55, "x", "y", "r"),
    "case when x is null or y is null then null else x or y end",
    _flags,
    source=FLAG_SRC,
)
_on(
    "F56_and",
    "events",
    "event_id",
    E(56, "x", "y", "r"),
    "case when x is null or y is null then null else x and y end",
    _flags,
    source=FLAG_SRC,
)
_on(
    "F60_regex_extract",
    "events",
    "event_id",
    E(60, "props", out="r", x_type="text", s=r'"k": (\d+)', t="Int"),
    "regexp_extract(props, '\"k\": (\\d+)', 1)::bigint",
)
_on(
    "F60_regex_groups",
    "supplier",
    "s_suppkey",
    E(60, "s_name", out="r", x_type="text", s=r"([A-Z][a-z]{3}).*(\d{3})$", t="Str"),
    "regexp_extract(s_name, '([A-Z][a-z]{3}).*(\\d{3})$', 1) || '|' || regexp_extract(s_name, '([A-Z][a-z]{3}).*(\\d{3})$', 2)",
)
_on(
    "F160_regex_extract_self",
    "part",
    "p_partkey",
    E(160, "p_brand", out="r", x_type="text", s=r"#(\d)$", t="Int"),
    "nullif(regexp_extract(p_brand, '#(\\d)$', 1), '')::bigint",
)
_on(
    "F61_regex_remove",
    "part",
    "p_partkey",
    E(61, "p_brand", out="r", x_type="text", s="Brand|#", t="Int"),
    "replace(replace(p_brand,'Brand',''),'#','')::bigint",
)
_on(
    "F62_regex_replace",
    "customer",
    "c_custkey",
    E(62, "c_name", out="r", x_type="text", s=r"(\w+)#0+(\d*)", t=r"\2:\1"),
    "regexp_replace(c_name, '(\\w+)#0+(\\d*)', '\\2:\\1', 'g')",
)
_on(
    "F70_merge",
    "events",
    "event_id",
    E(70, "x", "y", "r", x_type="text", y_type="text", t="Str"),
    "case when event_type in ('click','view') then nullif(props,'') else event_type end",
    lambda df: df.withColumn("x", F.when(F.col("event_type") == "click", F.lit("")).when(F.col("event_type") != "view", F.col("event_type")))
    .withColumn("y", F.col("props")),
)
_on(
    "F71_lookup",
    "orders",
    "o_orderkey",
    E(71, "o_orderstatus", out="r", x_type="text", s="O|F", t="open|finished"),
    "case o_orderstatus when 'O' then 'open' when 'F' then 'finished' else o_orderstatus end",
)
_on_lineitem(
    "F72_type_convert",
    E(72, "l_extendedprice", out="r", x_type="real", t="Int"),
    "case when floor(l_extendedprice) = l_extendedprice then l_extendedprice::bigint end",
)


def _shift(t):
    spec = E(80, "value", out="r", x_type="real", s="0", t="1")
    return apply_equations(t.events.select("event_id", "ts", "value"), [spec], order=["ts", "event_id"]).select("event_id", "r")


R.add("F80_shift", _shift, "select event_id, lag(value, 1, 0) over (order by ts, event_id) as r from events")


def _shift_keyed(t):
    spec = E(80, "event_type", out="r", x_type="text", s="none", t="-2")
    df = t.events.select("event_id", "ts", "user_id", "event_type")
    return apply_equations(df, [spec], order=["ts", "event_id"], keys=["user_id"]).select("event_id", "r")


R.add(
    "F80_shift_per_serial",
    _shift_keyed,
    "select event_id, lead(event_type, 2, 'none') over (partition by user_id order by ts, event_id) as r from events",
)

GAP = "(select event_id, ts, user_id, case when event_type <> 'error' then value end as v from events) s"


def _fill(letters, keys=()):
    def build(t):
        spec = E(90, "v", out="r", x_type="real", s="-1", t=letters)
        df = t.events_gap.select("event_id", "ts", "user_id", "v")
        return apply_equations(df, [spec], order=["ts", "event_id"], keys=keys).select("event_id", "r")

    return build


R.add("F90_fill_constant", _fill("c"), f"select event_id, coalesce(v, -1) as r from {GAP}")
R.add(
    "F90_fill_forward_constant",
    _fill("bc"),
    "select event_id, coalesce(last_value(v ignore nulls) over (order by ts, event_id rows between unbounded preceding"
    f" and current row), -1) as r from {GAP}",
)
R.add(
    "F190_fill_backward_per_serial",
    _fill("f", ["user_id"]),
    "select event_id, first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between"
    f" current row and unbounded following) as r from {GAP}",
)
_on_lineitem(
    "F120_remove_numbers",
    E(120, "l_quantity", out="r", a=1, b=25, c=50),
    "case when l_quantity in (1,25,50) then null else l_quantity end",
)
_on_lineitem(
    "F121_remove_range",
    E(121, "l_quantity", out="r", a=10, b=20),
    "case when l_quantity between 10 and 20 then null else l_quantity end",
)
_on_lineitem(
    "F122_pass_range",
    E(122, "l_quantity", out="r", a=10, b=20),
    "case when l_quantity < 10 or l_quantity > 20 then null else l_quantity end",
)
_on(
    "F131_remove_text",
    "events",
    "event_id",
    E(131, "event_type", out="r", x_type="text", s="error", t="Cat"),
    "nullif(event_type, 'error')",
)


def _self_ids(t):
    """The ids that overwrite their own column, chained."""
    specs = [
        E(161, "p_brand", x_type="text", s="Brand|#", t="Str"),
        E(162, "p_name", x_type="text", s="blue", t="navy"),
        E(171, "p_type", x_type="text", s="PROMO|SMALL", t="promo|small"),
        E(172, "p_size", x_type="int", t="Real"),
        E(170, "p_type", "p_name", x_type="text", y_type="text", t="Str"),
    ]
    return apply_equations(t.part, specs).select("p_partkey", "p_brand", "p_name", "p_type", "p_size")


R.add(
    "F161_F172_self_chain",
    _self_ids,
    "select p_partkey, replace(replace(p_brand,'Brand',''),'#','') as p_brand, replace(p_name,'blue','navy') as p_name,"
    " case p_type when 'PROMO' then 'promo' when 'SMALL' then 'small' else p_type end as p_type,"
    " p_size::double as p_size from part",
)
