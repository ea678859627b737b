"""A and B: profiling, typing, repair; C: reshape."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rounded
from millrace.bindings.links import lineitem_with_id
from millrace.functions import repair
from millrace.operators import cleaning, reshape
from millrace.plans import importer
from millrace.sources import files, profile, tables

R = Registry()

# --- sources ---

R.add(
    "A5_na_texts",
    lambda t: files.na_candidates(t.events.select(F.when(F.col("event_type") == "error", "--").otherwise(F.col("value").cast("string")).alias("v")), ["v"]),
    "select '--' as value, count(*) as n from events where event_type = 'error'",
)
R.add(
    "A5_escape_values",
    lambda t: files.escape_values(t.lineitem.select(F.when(F.col("l_linenumber") == 3, 9999).otherwise(F.col("l_partkey")).alias("v"), "l_suppkey"), ["v", "l_suppkey"]),
    """with c as (select 'v' as "column", case when l_linenumber = 3 then 9999 else l_partkey end::varchar as "value" from lineitem
union all select 'l_suppkey', l_suppkey::varchar from lineitem)
select "column", "value", count(*) as n from c where regexp_matches("value", '^(9+\\.?9*)$') group by 1, 2 having count(*) > 1""",
)


def _unique_names(t: Tables):
    """The same columns twice: the second set gets suffixes."""
    names = reshape.number_names(["r_regionkey", "r_name", "r_name", "r_regionkey"])
    return t.region.select("r_regionkey", "r_name", "r_name", "r_regionkey").toDF(*names)


R.add(
    "A6_unique_column_names",
    _unique_names,
    "select r_regionkey, r_name, r_name as r_name_01, r_regionkey as r_regionkey_01 from region",
)
R.add(
    "A7_dummy_header",
    lambda t: t.nation.toDF(*files.dummy_header(3)),
    "select n_nationkey as column_1, n_name as column_2, n_regionkey as column_3 from nation",
)
R.add(
    "A9_browse",
    lambda t: tables.browse(t.part.select("p_partkey", "p_retailprice"), "p_partkey", True, 50),
    "select p_partkey, p_retailprice from part order by p_partkey desc limit 50",
)


def _pull(t: Tables):
    lo, hi = t.events.agg(F.min("ts"), F.max("ts")).first()
    window = tables.pull_window("future", lo, lo + timedelta(days=5), hi, timedelta(hours=36))
    return tables.pull(t.events, "ts", window).select("event_id")


R.add(
    "A10_pull_newer",
    _pull,
    """with m as (select min(ts) + interval '5 days' as lo from events)
select event_id from events, m where ts >= lo and ts < lo + interval '36 hours'""",
)
R.add(
    "A11_distinct_pull",
    lambda t: tables.distinct_in_ranges(t.orders.select("o_orderdate", "o_orderstatus"), "o_orderdate", tables.time_ranges(datetime(1996, 1, 1), datetime(1996, 3, 1), 240)),
    "select distinct o_orderdate, o_orderstatus from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-03-01'",
)


def _shards(t: Tables):
    """Orders split by year; only the years that meet the window are read."""
    spans = {str(y): (datetime(y, 1, 1), datetime(y, 12, 31, 23, 59, 59)) for y in range(1995, 2002)}
    start, end = datetime(1997, 6, 1), datetime(1999, 2, 1)
    parts = [t.orders.where(F.year("o_orderdate") == int(y)) for y in tables.shards_in(spans, start, end)]
    return tables.pull(tables.union_shards(parts), "o_orderdate", (start, end)).select("o_orderkey")


R.add(
    "A12_partition_tables",
    _shards,
    "select o_orderkey from orders where o_orderdate >= timestamp '1997-06-01' and o_orderdate < timestamp '1999-02-01'",
)


def _eav(t: Tables):
    """Line items as measurements, orders as events, suppliers as equipment, nations as lines."""
    measures = reshape.to_long(lineitem_with_id(t), ["l_id", "l_orderkey", "l_suppkey"], ["l_quantity", "l_tax"], False, [])
    out = tables.measurement_records(
        measures.withColumnsRenamed({"l_orderkey": "o_orderkey", "l_suppkey": "s_suppkey"}),
        t.orders.select("o_orderkey", "o_orderdate"),
        t.supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")),
        t.nation.select("n_nationkey", "n_name"),
        {"event": "o_orderkey", "equip": "s_suppkey", "line": "n_nationkey"},
    )
    return out.groupBy("n_name", "data_name").agg(F.count("*").alias("n"))


R.add(
    "A14_measurement_records",
    _eav,
    """select n_name, d as data_name, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
join nation on s_nationkey = n_nationkey, (values ('l_quantity'),('l_tax')) v(d) group by 1, 2""",
)
R.add(
    "A16_standard_names",
    lambda t: files.standard_names(t.supplier, {"s_suppkey": "EquipId", "s_name": "Equip", "s_missing": "Line"}),
    'select s_suppkey as "EquipId", s_name as "Equip", s_nationkey, s_acctbal from supplier',
)
R.add(
    "A17_export_rows",
    lambda t: t.events.select(F.col("event_id").alias("id"), F.date_format(F.from_utc_timestamp("ts", "Asia/Tokyo"), "yyyy-MM-dd HH:mm:ss").alias("local_time")),
    "select event_id as id, strftime(ts + interval '9 hours', '%Y-%m-%d %H:%M:%S') as local_time from events",
)
R.add(
    "A22_batches_to_send",
    lambda t: importer.batches_to_send(t.orders.groupBy("o_orderdate").agg(F.count("*").alias("n")), "o_orderdate", "n", 500),
    """select o_orderdate, n from (select o_orderdate, count(*) as n, sum(count(*)) over (order by o_orderdate) as s from orders group by 1) where s - n <= 500""",
)
R.add(
    "A22_newer_than_mark",
    lambda t: tables.newer_than(t.events, "event_id", 300).select("event_id"),
    "select event_id from events where event_id > 300",
)
R.add(
    "A24_without_archived",
    lambda t: importer.without_ids(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", t.lineitem.where(F.col("l_returnflag") == "R").select("l_orderkey")),
    "select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
)

# --- typing and validation ---

COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_shipdate"]


def _as_text(t: Tables):
    return t.lineitem.select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])


R.add("B1_preview_types", lambda t: profile.types_table(_as_text(t), COLUMNS, profile.preview_type),
      """select * from (values ('l_orderkey','INTEGER'),('l_linenumber','INTEGER'),('l_quantity','REAL'),('l_tax','REAL'),('l_returnflag','TEXT'),('l_shipdate','DATETIME')) v("column", "type")""")  # fmt: skip
R.add("B2_import_types", lambda t: profile.types_table(_as_text(t), COLUMNS),
      """select 'l_orderkey' as "column", case when max(l_orderkey) < 32768 then 'SMALL_INT' else 'INTEGER' end as "type" from lineitem
union all select * from (values ('l_linenumber','SMALL_INT'),('l_quantity','SMALL_INT'),('l_tax','REAL'),('l_returnflag','TEXT'),('l_shipdate','DATE')) v""")  # fmt: skip


def _facts(t: Tables):
    facts = profile.column_facts(_as_text(t), ["l_quantity", "l_tax", "l_returnflag"])
    return facts.select("column", "known", "numbers", "whole", "bits", "distinct", "longest")


R.add(
    "B3_column_facts",
    _facts,
    """select 'l_quantity' as "column", count(*) as known, count(*) as numbers, count(*) as whole, count(*) filter (l_quantity in (0,1)) as bits,
 count(distinct l_quantity) as "distinct", 4::bigint as longest from lineitem
union all select 'l_tax', count(*), count(*), count(*) filter (l_tax = 0), count(*) filter (l_tax = 0), count(distinct l_tax), 4 from lineitem
union all select 'l_returnflag', count(*), 0, 0, 0, count(distinct l_returnflag), 1 from lineitem""",
)


def _counts(t: Tables):
    cols = ["l_linenumber", "l_returnflag"]
    early = t.lineitem.where(F.col("l_shipdate") < F.lit(datetime(1998, 1, 1)))
    late = t.lineitem.where(F.col("l_shipdate") >= F.lit(datetime(1998, 1, 1)))
    return profile.merge_counts([profile.value_counts(early, cols), profile.value_counts(late, cols)])


R.add(
    "B4_merged_counts",
    _counts,
    """select 'l_linenumber' as "column", l_linenumber::varchar as "value", count(*) as n from lineitem group by 2
union all select 'l_returnflag', l_returnflag, count(*) from lineitem group by 2""",
)


def _messy(t: Tables):
    """Measured values as the texts a machine might write."""
    v, k = F.col("value"), F.col("event_id") % 10
    text = (
        F.when(k == 0, "NA").when(k == 1, "Inf").when(k == 2, "-1/0").when(k == 3, "broken")
        .when(k == 4, F.concat(F.lit("' "), v.cast("string"), F.lit(" '"))).otherwise(v.cast("string"))
    )
    return t.events.select("event_id", text.alias("txt"), F.when(k < 5, F.lit(None)).otherwise(F.col("user_id").cast("string")).alias("num"))


def _cast(t: Tables, what: int):
    return cleaning.cast_and_reject(_messy(t), {"txt": "REAL", "num": "SMALL_INT"}, ["NA"])[what]


R.add(
    "B5_cast_good",
    lambda t: _cast(t, 0),
    """with m as (select event_id, case event_id % 10 when 0 then null when 1 then 'inf'::double when 2 then null when 3 then null when 4 then null else value end as txt,
 case when event_id % 10 >= 5 then user_id::smallint end as num from events) select * from m where txt is not null or num is not null""",
)
R.add(
    "B5_cast_rejected",
    lambda t: _cast(t, 1).select("event_id"),
    "select event_id from events where event_id % 10 in (0, 2, 3, 4)",
)
R.add(
    "B6_validate",
    lambda t: cleaning.validate(_messy(t), {"txt": "REAL", "num": "INTEGER"}),
    """select event_id, case event_id % 10 when 0 then null when 1 then 'inf'::double when 2 then '-inf'::double when 3 then null else value end as txt,
 case when event_id % 10 >= 5 then user_id::int end as num, event_id % 10 = 3 as is_error from events""",
)


def _times(t: Tables):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "not a time").when(k == 1, F.lit(None)).otherwise(F.concat(F.lit("'"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("'")))
    return t.events.select("event_id", text.alias("at"))


R.add(
    "B7_missing_time",
    lambda t: cleaning.split_missing(cleaning.parse_datetime(_times(t), "at"), "at")[1].select("event_id"),
    "select event_id from events where event_id % 4 in (0, 1)",
)
R.add(
    "B8_parse_datetime",
    lambda t: cleaning.parse_datetime(_times(t), "at", null_is_error=False),
    "select event_id, case when event_id % 4 >= 2 then date_trunc('second', ts) end as at, event_id % 4 = 0 as is_error from events",
)
R.add(
    "B9_time_zone",
    lambda t: cleaning.to_local(cleaning.to_utc(t.events.select("event_id", "ts", F.col("ts").alias("utc")), "utc", "Asia/Tokyo"), "ts", "Asia/Tokyo"),
    "select event_id, ts + interval '9 hours' as ts, ts - interval '9 hours' as utc from events",
)


def _variants(t: Tables):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "M-d")).when(k == 1, F.date_format(d, "yy/M/d"))
        .when(k == 2, F.date_format(d, "yyyy年M月d日")).otherwise(F.date_format(d, "yyyy年M月d日H時m分s秒"))
    )
    return t.orders.select("o_orderkey", text.alias("txt"))


R.add(
    "B10_datetime_repair",
    lambda t: _variants(t).select("o_orderkey", repair.repair_datetime(F.col("txt"), 2024).alias("iso")),
    """select o_orderkey, case o_orderkey % 4 when 0 then '2024' when 1 then '20' || strftime(o_orderdate, '%y') else strftime(o_orderdate, '%Y') end
 || '-' || month(o_orderdate) || '-' || day(o_orderdate) || case when o_orderkey % 4 = 3 then ' 0:0:0' else ' 00:00:00' end as iso from orders""",
)


def _dates(t: Tables):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.date_format(d, "yy.MM.dd")).when(k == 2, F.date_format(d, "yyyy年M月d日")).otherwise("2024-19-99")
    return t.orders.select("o_orderkey", repair.repair_date(text).alias("day"))


R.add(
    "B11_date_repair",
    _dates,
    """select o_orderkey, case o_orderkey % 4 when 3 then null when 1 then '20' || strftime(o_orderdate, '%y-%m-%d') else strftime(o_orderdate, '%Y-%m-%d') end as day from orders""",
)


def _clock(t: Tables):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "H時m分s秒")).when(k == 1, F.date_format("ts", "H.m.s")).when(k == 2, F.date_format("ts", "HH mm ss")).otherwise("25:99:00")
    return t.events.select("event_id", repair.repair_time(text).alias("clock"))


R.add(
    "B12_time_repair",
    _clock,
    """select event_id, case event_id % 4 when 3 then null else strftime(ts, '%H:%M:%S') end as clock from events""",
)
R.add(
    "B13_user_format",
    lambda t: cleaning.convert_datetime_formats(t.events.select("event_id", F.date_format("ts", "dd.MM.yy HH:mm").alias("at")), {"at": "%d.%m.%y %H:%M"}),
    "select event_id, date_trunc('minute', ts) as at from events",
)
R.add(
    "B14_event_time",
    lambda t: cleaning.event_time(
        t.events.select("event_id", F.date_format("ts", "yyyy/M/d").alias("d"), F.date_format("ts", "H.m.s").alias("h")), "d", "h", "at", "Asia/Tokyo"
    ).select("event_id", "at"),
    "select event_id, date_trunc('second', ts) - interval '9 hours' as at from events",
)
R.add(
    "B15_dummy_time",
    lambda t: cleaning.dummy_time(t.part.select("p_partkey"), ["p_partkey"], None, datetime(2024, 5, 17), "at"),
    "select p_partkey, timestamp '2024-05-01' + to_seconds((row_number() over (order by p_partkey) - 1)*10) as at from part",
)
R.add(
    "B15_dummy_time_after_stored",
    lambda t: cleaning.dummy_time(t.part.select("p_partkey"), ["p_partkey"], datetime(2024, 5, 3, 4), datetime(2024, 5, 17), "at"),
    "select p_partkey, timestamp '2024-05-04 04:00' + to_seconds((row_number() over (order by p_partkey) - 1)*10) as at from part",
)


def _normal(t: Tables):
    wide = F.translate(F.col("p_name"), "abcdefghijklmnopqrstuvwxyz ", "".join(chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz") + "　")
    raw = F.concat(F.lit("  ➊ "), wide, F.lit("　 25°C"))
    return t.part.select("p_partkey", repair.normalise_text(raw).alias("txt"))


R.add("B16_normalise_text", _normal, "select p_partkey, '1 ' || p_name || ' 25℃' as txt from part")
R.add(
    "B16_normalise_documents",
    lambda t: t.documents.select("doc_id", F.length(repair.normalise_text(F.col("text"))).alias("n"), (repair.normalise_text(F.col("text")) == F.col("text")).alias("same")),
)


def _europe(t: Tables):
    text = F.regexp_replace(F.format_number(F.col("l_extendedprice"), 2), ",", ".")
    text = F.regexp_replace(text, r"\.(\d\d)$", ",$1")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", repair.european_number(text, "eu_real_sep").alias("eu"),
        repair.european_number(F.format_number(F.col("l_extendedprice"), 2), "real_sep").alias("us"),
    )


R.add("B17_separated_numbers", _europe, "select l_orderkey, l_linenumber, l_extendedprice as eu, l_extendedprice as us from lineitem")


def _sentinels(t: Tables):
    k = F.col("event_id") % 8
    real = (
        F.when(k == 0, 9999.0).when(k == 1, -9999.9).when(k == 2, 99.999).when(k == 3, 1.1111)
        .when(k == 4, 99999999.0).otherwise(F.lit(12.5) + F.col("user_id"))
    )
    whole = F.when(k == 0, 9999).when(k == 1, -99999).when(k == 2, 1111).otherwise(F.col("user_id").cast("int") + 10_002)
    text = F.when(k == 0, "----").when(k == 1, "00007777").otherwise(F.col("event_type"))
    df = t.events.select("event_id", real.alias("r"), whole.alias("i"), text.alias("t"))
    out = cleaning.replace_sentinels(df, ["r", "i", "t"])
    return out


R.add(
    "B18_sentinels",
    _sentinels,
    """select event_id, case when event_id % 8 in (0,2,3,4) then 'inf'::double when event_id % 8 = 1 then '-inf'::double else 12.5 + user_id end as r,
 case when event_id % 8 < 3 then null when (user_id + 10002)::varchar in ('11111') then null else (user_id + 10002)::int end as i, case when event_id % 8 < 2 then null else event_type end as t from events""",
)


def _drop_counts(t: Tables):
    df = t.lineitem.withColumn("v", F.when(F.col("l_linenumber") == 1, F.lit(9999.5)).otherwise(F.col("l_extendedprice")))
    out = cleaning.drop_abnormal_counts(df, "v")
    return out.agg(F.count("v").alias("kept"), F.count("*").alias("n"))


R.add(
    "B19_B20_drop_abnormal_counts",
    _drop_counts,
    "select count(*) filter (l_linenumber <> 1 and l_extendedprice <> 9999.5) as kept, count(*) as n from lineitem",
)
R.add(
    "B21_plot_types",
    lambda t: t.lineitem.select("l_orderkey", *[cleaning.typed(c, k).alias(c) for c, k in (("l_linenumber", "REAL"), ("l_quantity", "INTEGER"), ("l_tax", "TEXT"))]),
    "select l_orderkey, l_linenumber::double as l_linenumber, l_quantity::int as l_quantity, l_tax::varchar as l_tax from lineitem",
)


def _endless(t: Tables):
    df = t.events.select("event_id", F.when(F.col("event_type") == "view", float("inf")).when(F.col("event_type") == "click", float("-inf")).otherwise(F.col("value")).alias("v"))
    return cleaning.infinities_to_null(df, ["v"])


R.add("B22_infinities", _endless, "select event_id, case when event_type not in ('view','click') then value end as v from events")
R.add(
    "B23_drop_missing",
    lambda t: cleaning.drop_missing(t.events_gap, ["v", "event_type"]).select("event_id"),
    "select event_id from events where event_type <> 'error'",
)


def _model(t: Tables):
    df = t.events.select(
        "event_id", "value", F.when(F.col("event_type") == "view", F.col("value")).alias("sparse"),
        F.when(F.col("event_type") != "error", F.col("user_id").cast("double")).alias("u"), F.lit(3.0).alias("same"),
    )
    rows, kept, constant = cleaning.clean_for_model(df, ["value", "sparse", "u", "same"])
    return rows.select("event_id").withColumns({"kept": F.lit(",".join(kept)), "constant": F.lit(",".join(constant))})


R.add(
    "B24_clean_for_model",
    _model,
    "select event_id, 'value,u,same' as kept, 'same' as constant from events where event_type <> 'error'",
)


def _coefficients(t: Tables):
    x = F.col("l_quantity")
    ops = {"plus": ("+", "1.5"), "minus": ("-", "2"), "times": ("*", "3"), "over": ("/", "4")}
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", *[repair.with_coefficient(x, o, c).alias(n) for n, (o, c) in ops.items()],
        repair.with_coefficient(F.col("l_returnflag"), "regex", "[AR]").alias("kept"),
    )


R.add(
    "B25_coefficients",
    _coefficients,
    "select l_orderkey, l_linenumber, l_quantity+1.5 as plus, l_quantity-2 as minus, l_quantity*3 as times, l_quantity/4 as over,"
    " case when l_returnflag in ('A','R') then l_returnflag end as kept from lineitem",
)
R.add(
    "B26_zero_padding",
    lambda t: t.part.select("p_partkey", repair.padded(F.col("p_size"), 5).alias("padded"), repair.padded(F.col("p_type"), 7, "*", True).alias("filled")),
    "select p_partkey, lpad(p_size::varchar, 5, '0') as padded, case when length(p_type) >= 7 then p_type else rpad(p_type, 7, '*') end as filled from part",
)
R.add(
    "B27_failed_casts",
    lambda t: cleaning.failed_casts(t.part.select(F.regexp_replace("p_brand", "Brand#1", "1").alias("v")), "v", "INTEGER"),
    "select v as value, count(*) as n from (select regexp_replace(p_brand, 'Brand#1', '1') as v from part) where try_cast(v as int) is null group by 1",
)
R.add(
    "B28_same_value_columns",
    lambda t: cleaning.same_value_columns(t.part.withColumn("plant", F.lit("P1")), ["p_size", "plant"]),
    """select 'p_size' as "column", min(p_size) = max(p_size) as is_same from part union all select 'plant', true""",
)


def _candidates(t: Tables):
    df = t.events.select(F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    date, serial = cleaning.choose_date_and_serial(df, ["stamp", "user_id", "kind"])
    return cleaning.candidate_columns(df, ["stamp", "user_id", "kind"]).withColumns({"date": F.lit(date), "serial": F.lit(serial)})


R.add(
    "B29_candidate_columns",
    _candidates,
    """select 'stamp' as "column", count(*) as digits14, count(*) as known, 'stamp' as "date", 'user_id' as serial from events
union all select 'user_id', 0, count(*), 'stamp', 'user_id' from events
union all select 'kind', 0, count(*) filter (event_type <> 'error'), 'stamp', 'user_id' from events""",
)
R.add(
    "B30_availability",
    lambda t: rounded(cleaning.availability(t.events_gap, ["v", "value"]), "ratio"),
    """select 'v' as "column", round(count(*) filter (event_type <> 'error')/count(*),6) as ratio from events union all select 'value', 1.0::double""",
)


def _points(t: Tables):
    df = t.events.select(
        F.when(F.col("user_id") % 7 != 0, F.col("ts")).alias("x"),
        F.when(F.col("event_type") == "view", float("inf")).when(F.col("event_type") == "click", float("-inf"))
        .when(F.col("event_type") != "error", F.col("value")).alias("y"),
    )
    return cleaning.point_types(df, "x", "y", 1.0, 100.0).groupBy("y_type").agg(F.count("*").alias("n"))


R.add(
    "B31_point_types",
    _points,
    """select case when user_id % 7 = 0 then 'unlinked' when event_type = 'error' then 'none' when event_type = 'view' then 'inf' when event_type = 'click' then 'neg_inf'
 when value > 100 then 'outlier' when value < 1 then 'neg_outlier' else 'normal' end as y_type, count(*) as n from events group by 1""",
)

# --- reshape ---

MEASURES = ["l_quantity", "l_linenumber"]


def _long(t: Tables, distinct: bool):
    return reshape.to_long(t.lineitem, ["l_partkey"], MEASURES, distinct)


LONG_SQL = """select {d} l_partkey, 'l_linenumber' as data_name, l_linenumber::varchar as data_value, null::varchar as data_id, null::varchar as unit from lineitem
union all select {d} l_partkey, 'l_quantity', l_quantity::varchar, null, null from lineitem"""
R.add("C1_wide_to_long_distinct", lambda t: _long(t, True), LONG_SQL.format(d="distinct"))
R.add("C2_wide_to_long", lambda t: _long(t, False), LONG_SQL.format(d=""))


def _wide(t: Tables):
    long = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type", "value", "event_id", F.col("props").alias("lot"))
    return reshape.to_wide(long, ["user_id", "day"], ["lot"], "event_type", "value", ["event_id"])


R.add(
    "C3_long_to_wide",
    _wide,
    "select user_id, ts::date as day, arg_max(props, event_id) as lot, "
    + ", ".join(f"arg_max(value, event_id) filter (event_type = '{k}') as {k}" for k in ("click", "error", "purchase", "signup", "view"))
    + " from events group by 1, 2",
)


def _sub_parts(t: Tables):
    df = t.part.select("p_partkey", F.concat(F.lit("JP"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("sub"),
                       F.col("p_brand").alias("tray"), F.col("p_type").alias("lot"), F.col("p_name").alias("serial"))
    return reshape.sub_part_history(df.withColumn("sub", F.when(F.col("p_partkey") % 5 != 0, F.col("sub"))), "sub", "tray", "lot", "serial")


R.add(
    "C4_sub_part_rows",
    _sub_parts,
    """select p_partkey, n || '_' || substr(lpad(p_partkey::varchar, 10, '0'), 1, 6) as data_name,
 case n when 'SUB_TRAY_NO' then p_brand when 'SUB_LOT_NO' then p_type else p_name end as data_value
 from part, (values ('SUB_TRAY_NO'),('SUB_LOT_NO'),('SUB_SERIAL')) v(n) where p_partkey % 5 <> 0""",
)


def _repeated(t: Tables):
    number = F.concat(F.lit("JP"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    df = t.part.select("p_partkey", number.alias("Ko1Shinaban"), F.col("p_type").alias("Ko1Lot"), F.col("p_brand").alias("Sub2Part"))
    return reshape.repeated_groups(df, ["p_partkey"], 2)


R.add(
    "C5_repeated_groups",
    _repeated,
    """select p_partkey, 'Sub1Part' as data_name, right(lpad(p_partkey::varchar, 10, '0'), 4) as data_value from part
union all select p_partkey, 'Sub1Lot', p_type from part union all select p_partkey, 'Sub2Part', p_brand from part""",
)
R.add(
    "C6_parts_with_groups",
    lambda t: reshape.with_groups(t.part, ["p_brand"], ["SUB_TRAY_NO", "SUB_LOT_NO", "SUB_SERIAL"]),
    "select distinct p_brand, g as data_group from part, (values ('SUB_TRAY_NO'),('SUB_LOT_NO'),('SUB_SERIAL')) v(g)",
)
R.add(
    "C7_parts_with_flag",
    lambda t: reshape.parts_with_flag(t.lineitem, "l_partkey", "l_suppkey"),
    "select part_no, max(a) as assy from (select l_partkey as part_no, true as a from lineitem union all select l_suppkey, false from lineitem) group by 1",
)


def _standard(t: Tables):
    return reshape.standard_columns(t.orders, {"o_orderkey": "DATA_SERIAL", "o_orderdate": "DATA_TIME"}, ["o_orderpriority"], ["4-NOT SPECIFIED"])


R.add(
    "C8_standard_columns",
    _standard,
    """select o_orderkey as "DATA_SERIAL", o_orderdate as "DATA_TIME", nullif(o_orderpriority, '4-NOT SPECIFIED') as o_orderpriority from orders""",
)


def _extra(t: Tables):
    long = reshape.to_long(t.part, ["p_partkey", "p_brand"], ["p_size"], False, ["data_id"])
    return reshape.add_extra_rows(long, ["p_partkey", "p_brand"], "product", "PROD", F.regexp_extract("p_brand", r"#(1\d)$", 0)).where(F.col("data_value") != "")


R.add(
    "C9_extra_rows",
    _extra,
    """select p_partkey, p_brand, 'p_size' as data_name, p_size::varchar as data_value, null::varchar as data_id from part
union all select p_partkey, p_brand, 'product', '#' || p_brand[7:], 'PROD' from part where regexp_matches(p_brand, '#1\\d$')""",
)
R.add(
    "C10_cross_tab",
    lambda t: reshape.matrix_cells(t.part, "p_type", "p_brand", F.count("*"), "n"),
    """select t.p_type, b.p_brand, nullif(count(p.p_partkey), 0) as n from (select distinct p_type from part) t cross join (select distinct p_brand from part) b
left join part p on p.p_type = t.p_type and p.p_brand = b.p_brand group by 1, 2""",
)
