"""D1-D23: linking, and the flagship query."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rounded
from millrace.functions.equations import EquationSpec
from millrace.operators import links, summary
from millrace.plans.trace import LinkGraph, prepare_analysis, trace
from millrace.spec import AnalysisSpec, DuplicateShow, FilterSpec, LinkEdge, LinkKey, ProcessSpec

R = Registry()

PROCESSES = {
    "orders": ProcessSpec("orders", "o_orderkey", "o_orderdate", ("o_orderkey",)),
    "lineitem": ProcessSpec("lineitem", "l_id", "l_shipdate", ("l_orderkey",)),
    "customer": ProcessSpec("customer", "c_custkey", "c_custkey"),
}
EDGE = LinkEdge("orders", "lineitem", (LinkKey("o_orderkey", "l_orderkey"),))


def lineitem_with_id(t: Tables):
    """Line items with a record id made of their natural key."""
    return t.lineitem.withColumn("l_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))


SQL_ID = "l_orderkey*100 + l_linenumber"
START, END = datetime(1996, 1, 1), datetime(1997, 1, 1)
IN_START = "o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'"
IN_END = "l_shipdate >= timestamp '1995-12-18' and l_shipdate < timestamp '1997-01-15'"


def request(**kw) -> AnalysisSpec:
    return AnalysisSpec("orders", START, END, {"lineitem": ["l_extendedprice"]}, sentinels=False, **kw)


def linked(t: Tables, spec: AnalysisSpec):
    return trace(spec, LinkGraph([EDGE]), PROCESSES, {"orders": t.orders, "lineitem": lineitem_with_id(t)})


R.add(
    "D1_process_window",
    lambda t: links.time_window(t.orders, "o_orderdate", START, END).select("o_orderkey", "o_orderdate"),
    f"select o_orderkey, o_orderdate from orders where {IN_START}",
)


def _equi(t):
    left = links.time_window(t.orders, "o_orderdate", START, END)
    lo, hi = links.end_window(START, END)
    right = links.time_window(t.lineitem, "l_shipdate", lo, hi)
    out = links.equi_link(left, right, EDGE.keys)
    return out.select("o_orderkey", "o_orderstatus", "l_linenumber", "l_extendedprice")


R.add(
    "D2_D13_key_link_in_window",
    _equi,
    "select o_orderkey, o_orderstatus, l_linenumber, l_extendedprice from"
    f" (select * from orders where {IN_START}) o left join (select * from lineitem where {IN_END}) l"
    " on o_orderkey = l_orderkey",
)


def _text_link(t):
    """Text against number keys: both sides are compared as text."""
    left = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("cust_text"))
    return links.equi_link(left, t.customer.select("c_custkey", "c_mktsegment"), [LinkKey("cust_text", "c_custkey")]).select(
        "o_orderkey", "c_mktsegment"
    )


R.add(
    "D2_text_number_link",
    _text_link,
    "select o_orderkey, c_mktsegment from orders left join customer on o_custkey::varchar = c_custkey::varchar",
)


def _substring(t):
    """Characters 10-18 of the customer name against the name's digits on the other side."""
    left = t.customer.select("c_custkey", "c_name")
    right = t.supplier.select("s_suppkey", "s_name")
    return links.equi_link(left, right, [LinkKey("c_name", "s_name", (10, 18), (10, 18))]).select("c_custkey", "s_suppkey")


R.add(
    "D3_substring_link",
    _substring,
    "select c_custkey, s_suppkey from customer left join supplier on substr(c_name,10,9) = substr(s_name,10,9)",
)


def _timed(delta, cut, filtered=False):
    def build(t):
        ev = t.events
        left = ev.where(F.col("event_type") == "error").select(
            F.col("event_id").alias("err_id"), F.col("user_id").alias("err_user"), F.col("ts").alias("err_ts")
        )
        right = ev.where(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("buy_id"), F.col("user_id").alias("buy_user"), F.col("ts").alias("buy_ts")
        )
        key = [LinkKey("err_user", "buy_user")]
        out = links.time_link(left, right, "err_ts", "buy_ts", delta, cut, key, filtered)
        return out.select("err_id", "buy_id")

    return build


def _timed_sql(delta, cut, how="left"):
    return f"""
with e as (select event_id as err_id, user_id as eu, ts as et from events where event_type = 'error'),
b as (select event_id as buy_id, user_id as bu, ts as bt from events where event_type = 'purchase'),
j as (select err_id, buy_id, abs(epoch_us(bt) - epoch_us(et) - {delta}::bigint*60000000) as d from e {how} join b on eu = bu and bt > et
  and epoch_us(bt) < epoch_us(et) + ({delta} + {cut})::bigint*60000000
  and epoch_us(bt) > epoch_us(et) + ({delta} - {cut})::bigint*60000000),
r as (select *, rank() over (partition by err_id order by d) as k from j)
select err_id, buy_id from r where k = 1"""


R.add("D4_nearest_time_link", _timed(600, 480), _timed_sql(600, 480))
R.add("D4_time_link_backward", _timed(-60, 900), _timed_sql(-60, 900))


def _against(delta, cut):
    """From each purchase back to the nearest error before it."""

    def build(t):
        ev = t.events
        left = ev.where(F.col("event_type") == "purchase").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("buy_user"), F.col("ts").alias("buy_ts"))
        right = ev.where(F.col("event_type") == "error").select(F.col("event_id").alias("err_id"), F.col("user_id").alias("err_user"), F.col("ts").alias("err_ts"))
        key = LinkKey("err_ts", "buy_ts", delta_minutes=delta, cut_off_minutes=cut).reversed()
        how = {"keys": [LinkKey("buy_user", "err_user")], "earlier": key.earlier}
        return links.time_link(left, right, key.self_column, key.target_column, key.delta_minutes, key.cut_off_minutes, **how).select("buy_id", "err_id")

    return build


def _against_sql(delta, cut, where=""):
    return f"""
with e as (select event_id as err_id, user_id as eu, ts as et from events where event_type = 'error'),
b as (select event_id as buy_id, user_id as bu, ts as bt from events where event_type = 'purchase' {where}),
j as (select buy_id, err_id, et, abs(epoch_us(bt) - epoch_us(et) - {delta}::bigint*60000000) as d from b left join e on eu = bu and bt > et
  and epoch_us(bt) < epoch_us(et) + ({delta} + {cut})::bigint*60000000
  and epoch_us(bt) > epoch_us(et) + ({delta} - {cut})::bigint*60000000),
r as (select *, rank() over (partition by buy_id order by d) as k from j)
select buy_id, err_id from r where k = 1"""


R.add("D4_time_link_against_direction", _against(600, 480), _against_sql(600, 480))
R.add("D4_time_link_back_against_direction", _against(-60, 900), _against_sql(-60, 900))


def _downstream(t):
    """The same link through an analysis that starts at the later process."""
    ev = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), "ts", "event_type")
    graph = LinkGraph([LinkEdge("error", "purchase", (LinkKey("user", "user"), LinkKey("ts", "ts", delta_minutes=600, cut_off_minutes=480)))])
    processes = {p: ProcessSpec(p, "id", "ts", ("user",)) for p in ("error", "purchase")}
    spec = AnalysisSpec("purchase", datetime(2024, 1, 8), datetime(2024, 1, 22), {"error": ["id"]})
    tables = {p: ev.where(F.col("event_type") == p) for p in processes}
    return trace(spec, graph, processes, tables).select(F.col("purchase__id").alias("buy_id"), F.col("error__id").alias("err_id"))


R.add(
    "D11_time_link_from_downstream",
    _downstream,
    f"""select buy_id, err_id from (select j.*, row_number() over (partition by buy_id order by ts desc, err_id) as n
from ({_against_sql(600, 480, "and ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22'")}) j left join events on event_id = err_id) where n = 1""",
)
R.add("D5_time_link_filtered", _timed(600, 480, True), _timed_sql(600, 480, "inner"))


def _inner(t):
    spec = request(filters={"lineitem": [FilterSpec("l_returnflag", "matches", ("R",))]})
    return linked(t, spec).select(
        F.col("orders__o_orderkey").alias("order_id"), F.col("lineitem__l_id").alias("line_id")
    )


R.add(
    "D5_inner_when_filtered",
    _inner,
    f"""
with o as (select *, row_number() over (partition by o_orderkey order by o_orderdate desc, o_orderkey) rn from orders where {IN_START}),
l as (select {SQL_ID} as l_id, *, row_number() over (partition by l_orderkey order by l_shipdate desc, {SQL_ID}) rn
  from lineitem where {IN_END} and l_returnflag = 'R')
select o_orderkey as order_id, l_id as line_id from o join l on o_orderkey = l_orderkey and o.rn = l.rn""",
)

TERMS = [
    (datetime(2024, 1, 1), datetime(2024, 1, 8)),
    (datetime(2024, 1, 5), datetime(2024, 1, 12)),
    (datetime(2024, 1, 20), datetime(2024, 1, 25)),
]


def _terms(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", links.term_of(ts, TERMS, True).alias("term_from"), links.term_of(ts, TERMS, False).alias("term_to")
    )


R.add(
    "D6_term_lookup",
    _terms,
    """select event_id, terms_from as term_from, terms_to as term_to from (select event_id,
case when ts between timestamp '2024-01-01' and timestamp '2024-01-08' then timestamp '2024-01-01'
 when ts between timestamp '2024-01-05' and timestamp '2024-01-12' then timestamp '2024-01-05'
 when ts between timestamp '2024-01-20' and timestamp '2024-01-25' then timestamp '2024-01-20' end as terms_from,
case when ts between timestamp '2024-01-01' and timestamp '2024-01-08' then timestamp '2024-01-08'
 when ts between timestamp '2024-01-05' and timestamp '2024-01-12' then timestamp '2024-01-12'
 when ts between timestamp '2024-01-20' and timestamp '2024-01-25' then timestamp '2024-01-25' end as terms_to from events)""",
)


def _numbered(t):
    df = lineitem_with_id(t).select("l_orderkey", "l_id", "l_shipdate")
    return links.number_duplicates(df, ["l_orderkey"], "l_shipdate", ["l_id"], "k").select("l_id", "k")


R.add(
    "D7_align_duplicates",
    _numbered,
    f"select {SQL_ID} as l_id, row_number() over (partition by l_orderkey order by l_shipdate desc, {SQL_ID}) as k from lineitem",
)


def _one(show):
    def build(t):
        df = lineitem_with_id(t).select("l_orderkey", "l_id", "l_shipdate")
        return links.one_per_key(df, ["l_orderkey"], "l_shipdate", ["l_id"], show)

    return build


def _one_sql(way):
    return (
        f"select l_orderkey, l_id, l_shipdate from (select *, {SQL_ID} as l_id, row_number() over (partition by l_orderkey"
        f" order by l_shipdate {way}, {SQL_ID}) as rn from lineitem) where rn = 1"
    )


R.add("D8_first_per_key", _one(DuplicateShow.FIRST), _one_sql("asc"))
R.add("D8_last_per_key", _one(DuplicateShow.LAST), _one_sql("desc"))


def _trace_last(t):
    return linked(t, request(duplicates=DuplicateShow.LAST)).select(
        F.col("orders__o_orderkey").alias("order_id"), F.col("lineitem__l_id").alias("line_id")
    )


R.add(
    "D9_one_per_start",
    _trace_last,
    f"""
with l as (select l_orderkey, {SQL_ID} as l_id, row_number() over (partition by l_orderkey order by l_shipdate desc, {SQL_ID}) rn
  from lineitem where {IN_END})
select o_orderkey as order_id, l_id as line_id from (select * from orders where {IN_START}) o
left join l on o_orderkey = l_orderkey and rn = 1""",
)


def _two_paths(t):
    """orders -> lineitem and orders -> customer, combined on the order id."""
    tables = {"orders": t.orders, "lineitem": lineitem_with_id(t), "customer": t.customer}
    first = linked(t, request(duplicates=DuplicateShow.FIRST))
    orders = links.time_window(t.orders, "o_orderdate", START, END).select(
        F.col("o_orderkey").alias("orders__o_orderkey"), F.col("o_custkey").alias("_cust")
    )
    second = links.equi_link(
        orders, tables["customer"].select("c_custkey", "c_mktsegment"), [LinkKey("_cust", "c_custkey")]
    )
    return links.combine_paths(first, second, "orders__o_orderkey").select(
        F.col("orders__o_orderkey").alias("order_id"), F.col("lineitem__l_id").alias("line_id"), "c_mktsegment"
    )


R.add(
    "D10_combine_paths",
    _two_paths,
    f"""
with l as (select l_orderkey, {SQL_ID} as l_id, row_number() over (partition by l_orderkey order by l_shipdate, {SQL_ID}) rn
  from lineitem where {IN_END})
select o_orderkey as order_id, l_id as line_id, c_mktsegment from (select * from orders where {IN_START}) o
left join l on o_orderkey = l_orderkey and rn = 1 left join customer on o_custkey = c_custkey""",
)


def _skip_middle(t):
    """lineitem -> orders -> a second order table: the middle process passes its key through and is not joined."""
    graph = LinkGraph(
        [
            LinkEdge("lineitem", "orders", (LinkKey("l_orderkey", "o_orderkey"),)),
            LinkEdge("orders", "priority", (LinkKey("o_orderkey", "p_orderkey"),)),
        ]
    )
    second = t.orders.select(
        F.col("o_orderkey").alias("p_orderkey"), F.col("o_orderdate").alias("p_date"), "o_orderpriority"
    )
    processes = {**PROCESSES, "priority": ProcessSpec("priority", "p_orderkey", "p_date")}
    spec = AnalysisSpec("lineitem", datetime(1996, 1, 1), datetime(1996, 2, 1), {"priority": ["o_orderpriority"]},
                        duplicates=DuplicateShow.LAST, buffer_days=120)
    tables = {"lineitem": lineitem_with_id(t), "orders": t.orders, "priority": second}
    return trace(spec, graph, processes, tables).select(
        F.col("lineitem__l_id").alias("line_id"), F.col("priority__o_orderpriority").alias("priority")
    )


R.add(
    "D11_D12_path_without_middle",
    _skip_middle,
    f"""
with l as (select l_orderkey, {SQL_ID} as l_id, row_number() over (partition by l_orderkey order by l_shipdate desc, {SQL_ID}) rn
  from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-02-01')
select l_id as line_id, o_orderpriority as priority from l left join
 (select * from orders where o_orderdate >= timestamp '1995-09-03' and o_orderdate < timestamp '1996-05-31') o
 on l_orderkey = o_orderkey where rn = 1""",
)

R.add(
    "D14_link_count",
    lambda t: links.linked_rows(t.orders, t.lineitem, EDGE.keys).agg(F.count("*").alias("linked")),
    "select count(*) as linked from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey)",
)
R.add(
    "D15_link_simulation",
    lambda t: links.link_counts(
        [
            ("orders-lineitem", t.orders, t.lineitem, EDGE.keys),
            ("customer-orders", t.customer, t.orders, [LinkKey("c_custkey", "o_custkey")]),
        ]
    ),
    """select 'orders-lineitem' as edge, (select count(*) from orders) as total,
 (select count(*) from orders where o_orderkey in (select l_orderkey from lineitem)) as linked
union all select 'customer-orders', (select count(*) from customer),
 (select count(*) from customer where c_custkey in (select o_custkey from orders))""",
)
R.add(
    "D16_unique_ids",
    lambda t: links.unique_ids(_equi(t), "o_orderkey"),
    f"select count(distinct o_orderkey) as unique_ids from orders where {IN_START}",
)


def flagship(spark, folder: str):
    """Orders linked with line items, a derived price, outliers removed, summary per return flag."""
    t = Tables(spark, folder)
    left = links.time_window(t.orders, "o_orderdate", START, END)
    lo, hi = links.end_window(START, END)
    right = links.time_window(t.lineitem, "l_shipdate", lo, hi)
    df = links.equi_link(left, right, EDGE.keys).select(
        "o_orderkey", "o_orderdate", "l_returnflag", "l_extendedprice", "l_discount"
    )
    spec = request(
        equations=[EquationSpec(12, "l_extendedprice", "keep", "net_price", a=1, c=0)],
        outlier="O4M",
        outlier_columns=["net_price"],
    )
    df = prepare_analysis(df.withColumn("keep", 1 - F.col("l_discount")), spec, ["o_orderdate", "o_orderkey"])
    df = df.where(F.col("l_returnflag").isNotNull())
    out = summary.basic_stats(df, ["net_price"], ["l_returnflag"])
    return rounded(out, "mean", "sigma", "minimum", "maximum", "p25", "median", "p75", digits=4)


R.queries["flow_linked_summary"] = flagship
R.sql["flow_linked_summary"] = f"""
with j as (select l_returnflag, l_extendedprice*(1-l_discount) as net_price from (select * from orders where {IN_START}) o
 join (select * from lineitem where {IN_END}) l on o_orderkey = l_orderkey),
q as (select quantile_cont(net_price, 0.25) as q1, quantile_cont(net_price, 0.75) as q3 from j),
k as (select l_returnflag, case when q1 = q3 or net_price between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) then net_price end as net_price from j, q)
select l_returnflag, 'net_price' as variable, count(net_price) as n, round(avg(net_price),4) as mean,
 round(stddev_samp(net_price),4) as sigma, round(min(net_price),4) as minimum, round(max(net_price),4) as maximum,
 round(quantile_cont(net_price,0.25),4) as p25, round(quantile_cont(net_price,0.5),4) as median,
 round(quantile_cont(net_price,0.75),4) as p75 from k group by l_returnflag"""

