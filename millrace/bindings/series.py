"""H1-H20: ordering, thinning, terms, chunks, previews and plot rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rnd, rounded
from millrace.bindings.links import END, IN_END, IN_START, START, lineitem_with_id
from millrace.operators import aggregate, density, derive, links, series, summary
from millrace.spec import LinkKey

R = Registry()

R.add(
    "H1_order_by_columns",
    lambda t: series.sort_by(t.part, [("p_size", "desc"), "p_brand", "p_partkey"]).select("p_partkey", "p_size", "p_brand"),
    "select p_partkey, p_size, p_brand from part order by p_size desc, p_brand, p_partkey",
)


def _thin(t: Tables, by_time: bool, slots: int):
    out = series.thin(t.events, ["value"], "ts", ["event_type"], by_time, ["ts", "event_id"], slots)
    return rounded(out, "value_median")


def _thin_sql(slot):
    return f"""with m as (select min(epoch_us(ts)) lo, max(epoch_us(ts)) hi, count(*) n from events),
s as (select e.*, {slot} as slot from (select *, row_number() over (order by ts, event_id) - 1 as i from events) e, m),
c as (select slot, event_type as event_type_mode from s group by 1, 2 qualify row_number() over (partition by slot order by count(*) desc, event_type) = 1)
select slot, min(ts) as time_from, max(ts) as time_to, count(*) as n, min(value) as value_min, max(value) as value_max,
 round(quantile_cont(value, 0.5), 6) as value_median, any_value(event_type_mode) as event_type_mode from s join c using (slot) group by 1"""


R.add(
    "H2_thin_by_time",
    lambda t: _thin(t, True, 500),
    _thin_sql("floor(((epoch_us(ts)-lo)*1000)/(((hi-lo)*1000+1)/500.0::double))::bigint"),
)
R.add("H2_thin_by_count", lambda t: _thin(t, False, 300), _thin_sql("floor(i/ceil(n/300.0))::bigint"))
R.add("H2_thin_full_size", lambda t: _thin(t, True, 4000), _thin_sql("floor(((epoch_us(ts)-lo)*1000)/(((hi-lo)*1000+1)/4000.0::double))::bigint"))


def _resample(t: Tables):
    out = series.resample(t.events, "value", 201)
    return out.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), rnd(F.median("value")).alias("middle"))


R.add(
    "H3_resample",
    _resample,
    "select 201::bigint as n, min(value) as low, max(value) as high, round(quantile_cont(value,0.5),6) as middle from events",
)


def _cyclic(count, interval, window):
    def build(t):
        out = series.in_cyclic_terms(t.events, "ts", datetime(2024, 1, 3), count, interval, window)
        return out.groupBy("term").agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))

    return build


def _cyclic_sql(count, interval, window):
    return f"""with x as (select i::int as term, timestamp '2024-01-03' + to_minutes((i*{interval}*60)::bigint) as lo from range({count}) r(i))
select term, count(*) as n, round(sum(value),2) as total from x join events on ts >= lo and ts < lo + to_minutes(({window}*60)::bigint) group by 1"""


R.add("H4_cyclic_terms_with_gaps", _cyclic(7, 24, 12), _cyclic_sql(7, 24, 12))
R.add("H4_cyclic_terms_overlapping", _cyclic(10, 6, 30), _cyclic_sql(10, 6, 30))
R.add("H4_cyclic_terms_backward", _cyclic(5, -8, 12), _cyclic_sql(5, -8, 12))

TERMS = [(datetime(2024, 1, 1), datetime(2024, 1, 10)), (datetime(2024, 1, 5), datetime(2024, 1, 6)), (datetime(2024, 1, 28), datetime(2024, 3, 1))]
TERMS_SQL = """(values (0, timestamp '2024-01-01', timestamp '2024-01-10'), (1, timestamp '2024-01-05', timestamp '2024-01-06'),
 (2, timestamp '2024-01-28', timestamp '2024-03-01')) x(term, lo, hi)"""
R.add(
    "H5_direct_terms",
    lambda t: series.in_terms(t.events, "ts", TERMS).groupBy("term").agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total")),
    f"select term, count(*) as n, round(sum(value),2) as total from {TERMS_SQL} join events on ts >= lo and ts < hi group by 1",
)
R.add(
    "H6_calendar_division",
    lambda t: series.calendar_division(t.orders, "o_orderdate", [datetime(y, 1, 1) for y in (1996, 1997, 1998, 2000)], ["FY96", "FY97", "FY98-99"])
    .groupBy("division").agg(F.count("*").alias("n")),
    """select case when o_orderdate < timestamp '1997-01-01' then 'FY96' when o_orderdate < timestamp '1998-01-01' then 'FY97' else 'FY98-99' end as division,
 count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '2000-01-01' group by 1""",
)


def _latest_chunks(t: Tables):
    cut = series.chunks(t.events, 100, ["ts", "event_id"])
    return series.keep_chunks(cut, 4, latest=True).select("event_id", "chunk")


R.add(
    "H7_latest_chunks",
    _latest_chunks,
    """with c as (select event_id, ((row_number() over (order by ts, event_id)-1)//100)::bigint as chunk from events)
select event_id, chunk from c where chunk > (select max(chunk) from c) - 4""",
)
R.add(
    "H7_first_chunks_per_facet",
    lambda t: series.keep_chunks(series.chunks(t.events, 50, ["ts", "event_id"], ["event_type"]), 3, False, ["event_type"]).select("event_id", "chunk"),
    """with c as (select event_id, ((row_number() over (partition by event_type order by ts, event_id)-1)//50)::bigint as chunk from events)
select event_id, chunk from c where chunk < 3""",
)
R.add(
    "H8_scatter_by_term",
    lambda t: series.plot_rows(series.in_terms(t.events, "ts", TERMS), ["value", "user_id"], "event_type", ["term"]).groupBy("term", "event_type").agg(F.count("*").alias("n")),
    f"select term, event_type, count(*) as n from {TERMS_SQL} join events on ts >= lo and ts < hi group by 1, 2",
)


def _heatmap_terms(t: Tables):
    terms = series.in_cyclic_terms(t.events, "ts", datetime(2024, 1, 3), 7, 24, 12)
    return rounded(aggregate.aggregate(terms, "value", "mean", ["term", "event_type"], "r"), "r")


R.add(
    "H8_heatmap_by_cyclic_term",
    _heatmap_terms,
    """with x as (select i::int as term, timestamp '2024-01-03' + to_hours(i*24) as lo from range(7) r(i))
select term, event_type, round(avg(value),6) as r from x join events on ts >= lo and ts < lo + interval '12 hours' group by 1, 2""",
)
R.add(
    "H9_limited_groups",
    lambda t: series.limit_groups(t.part, "p_brand", 5, 3, ["p_partkey"], descending=True).select("p_brand", "p_partkey"),
    """select p_brand, p_partkey from part where p_brand in (select distinct p_brand from part order by 1 desc limit 5)
qualify row_number() over (partition by p_brand order by p_partkey) <= 3""",
)


def _stratified(t: Tables):
    terms = series.in_terms(t.events, "ts", TERMS)
    out = summary.basic_stats(terms, ["value"], ["term", "event_type"])
    return rounded(out, "mean", "sigma", "p25", "median", "p75", digits=4)


STATS_SQL = """count(value) as n, round(avg(value),4) as mean, round(stddev_samp(value),4) as sigma, min(value) as minimum, max(value) as maximum,
 round(quantile_cont(value,0.25),4) as p25, round(quantile_cont(value,0.5),4) as median, round(quantile_cont(value,0.75),4) as p75"""
R.add(
    "H10_stratified_by_term",
    _stratified,
    f"select term, event_type, 'value' as variable, {STATS_SQL} from {TERMS_SQL} join events on ts >= lo and ts < hi group by 1, 2",
)
R.add(
    "H10_stratified_by_category",
    lambda t: rounded(summary.basic_stats(t.events, ["value"], ["event_type"]), "mean", "sigma", "p25", "median", "p75", digits=4),
    f"select event_type, 'value' as variable, {STATS_SQL} from events group by 1",
)


def _ridge_terms(t: Tables):
    """Histogram per term; a term without records is absent from the counts and filled from the term list."""
    terms = series.cyclic_terms(datetime(2024, 1, 25), 8, 24, 24)
    counted = series.in_terms(t.events, "ts", terms).groupBy("term").agg(F.count("value").alias("n"), F.max("value").alias("high"))
    every = t.spark.range(len(terms)).select(F.col("id").cast("int").alias("term"))
    return every.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"), "high")


R.add(
    "H11_ridgeline_terms",
    _ridge_terms,
    """with x as (select i::int as term, timestamp '2024-01-25' + to_days(i::int) as lo from range(8) r(i))
select term, count(value) as n, max(value) as high from x left join events on ts >= lo and ts < lo + interval '1 day' group by 1""",
)


def _full_points(t: Tables):
    """Linked records in order, thinned."""
    left = links.time_window(t.orders, "o_orderdate", START, END)
    right = links.time_window(t.lineitem, "l_shipdate", *links.end_window(START, END))
    df = links.equi_link(left, right, [LinkKey("o_orderkey", "l_orderkey")], filtered=True)
    out = series.thin(df, ["l_extendedprice"], "o_orderdate", slots=200)
    return rounded(out, "l_extendedprice_median", digits=4)


R.add(
    "H12_full_points",
    _full_points,
    f"""with j as (select o_orderdate as ts, l_extendedprice as v from (select * from orders where {IN_START}) join (select * from lineitem where {IN_END}) on o_orderkey = l_orderkey),
m as (select min(epoch_us(ts)) lo, max(epoch_us(ts)) hi from j)
select floor(((epoch_us(ts)-lo)*1000)/(((hi-lo)*1000+1)/200.0::double))::bigint as slot, min(ts) as time_from, max(ts) as time_to, count(*) as n,
 min(v) as l_extendedprice_min, max(v) as l_extendedprice_max, round(quantile_cont(v,0.5),4) as l_extendedprice_median from j, m group by 1""",
)


def _period(t: Tables):
    df = links.equi_link(t.orders, lineitem_with_id(t), [LinkKey("o_orderkey", "l_orderkey")])
    return series.start_period(df, "o_orderdate", "l_shipdate", datetime(1997, 1, 1), datetime(1998, 1, 1))


R.add(
    "H13_start_period",
    _period,
    """with j as (select o_orderdate s, l_shipdate e from orders join lineitem on o_orderkey = l_orderkey
 where l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01')
select (select s from j order by e, s limit 1) as start_from, (select s from j order by e desc, s desc limit 1) as start_to""",
)
PERIODS = [(None, None), (datetime(2024, 1, 5), datetime(2024, 1, 20)), (datetime(2024, 1, 10), datetime(2024, 1, 15))]
R.add(
    "H14_threshold_in_force",
    lambda t: t.events.select("event_id", series.threshold_index(F.col("ts"), PERIODS[1:]).alias("idx")),
    """select event_id, case when ts between timestamp '2024-01-05' and timestamp '2024-01-20' then 0
 when ts between timestamp '2024-01-10' and timestamp '2024-01-15' then 1 else 0 end as idx from events""",
)
R.add(
    "H15_latest_records",
    lambda t: series.latest(t.events, ["ts", "event_id"], 100).select("event_id"),
    "select event_id from events order by ts desc, event_id desc limit 100",
)
R.add(
    "H16_parallel_rows",
    lambda t: derive.category_codes(t.part, "p_type", "type_code").select("p_partkey", "p_size", "type_code"),
    "select p_partkey, p_size, dense_rank() over (order by p_type) - 1 as type_code from part",
)
R.add(
    "H17_scatter_rows",
    lambda t: series.plot_rows(t.events_gap, ["v", "user_id"], "event_type").select("v", "user_id", "event_type"),
    "select value as v, user_id, event_type from events where event_type <> 'error'",
)


def _violin(t: Tables):
    """A number against a category: box statistics per label."""
    kind = series.scatter_type(False, True)
    out = summary.basic_stats(t.lineitem, ["l_extendedprice"], ["l_returnflag"]).select("l_returnflag", "p25", "median", "p75")
    return rounded(out, "p25", "median", "p75", digits=4).withColumn("chart", F.lit(kind))


R.add(
    "H17_violin",
    _violin,
    "select l_returnflag, round(quantile_cont(l_extendedprice,0.25),4) as p25, round(quantile_cont(l_extendedprice,0.5),4) as median,"
    " round(quantile_cont(l_extendedprice,0.75),4) as p75, 'violin' as chart from lineitem group by 1",
)


def _heatmap_numeric(t: Tables):
    """Two binned numbers as axes, mean of a third as colour."""
    df = t.lineitem.select(
        density.bin_of(F.col("l_quantity"), 1.0, 50.0, 7).alias("bx"),
        density.bin_of(F.col("l_discount"), 0.0, 0.1, 5).alias("by"),
        "l_extendedprice",
    )
    return rounded(aggregate.xy_heatmap(df, "bx", "by", "l_extendedprice", "mean", "r"), "r", digits=3)


R.add(
    "H18_heatmap_numeric_axes",
    _heatmap_numeric,
    "select least(floor((l_quantity-1.0::double)*(7/49.0::double)),6)::int as bx, least(floor(l_discount*(5/0.1::double)),4)::int as by, round(avg(l_extendedprice),3) as r from lineitem group by 1, 2",
)
R.add(
    "H19_day_ranges",
    lambda t: series.day_ranges(t.lineitem, "l_shipdate"),
    """with d as (select distinct l_shipdate::date as day from lineitem),
g as (select day, day - (row_number() over (order by day))::int as g from d)
select min(day) as day_from, max(day) + 1 as day_to from g group by g""",
)
