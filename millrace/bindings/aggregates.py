"""G1-G33: aggregates, summaries, densities, defect rates, co-occurrence, correlation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rnd, rounded
from millrace.operators import aggregate, cleaning, density, derive, multivariate, summary
from millrace.operators.quantiles import modes

R = Registry()

ROUND = {"mean": 4, "std": 4, "median": 4, "iqr": 4, "range": 4, "ratio": 6}
SQL_AGG = {
    "max": "max({c})",
    "min": "min({c})",
    "mean": "round(avg({c}),4)",
    "std": "round(stddev_samp({c}),4)",
    "range": "round(max({c})-min({c}),4)",
    "median": "round(quantile_cont({c},0.5),4)",
    "iqr": "round(quantile_cont({c},0.75)-quantile_cont({c},0.25),4)",
    "count": "count({c})",
    "ratio": "round(count({c})*100.0/(select count({c}) from {t}),6)",
}


def _agg(function):
    def build(t):
        out = aggregate.aggregate_plot(t.lineitem, "l_extendedprice", function, ["l_returnflag"], "l_linestatus", None, "r")
        return rounded(out, "r", digits=ROUND[function]) if function in ROUND else out

    return build


for _f, _sql in SQL_AGG.items():
    R.add(
        f"G1_G2_aggregate_{_f}",
        _agg(_f),
        f"select l_returnflag, l_linestatus, {_sql.format(c='l_extendedprice', t='lineitem')} as r from lineitem group by 1, 2",
    )
for _f, _order in (("first", ""), ("last", " desc")):
    R.add(
        f"G1_aggregate_{_f}",
        lambda t, f=_f: aggregate.aggregate(t.events, "value", f, ["event_type"], "r", "ts"),
        f"select event_type, value as r from events qualify row_number() over (partition by event_type order by ts{_order}) = 1",
    )
R.add(
    "G2_aggregate_with_others",
    lambda t: aggregate.aggregate_plot(derive.others(t.part, "p_brand", "brand"), "p_size", "count", [], "brand", "p_type", "n"),
    """with c as (select p_brand, row_number() over (order by count(*) desc, p_brand) rn from part group by 1)
select case when rn <= 8 then p_brand else 'Other' end as brand, p_type, count(p_size) as n from part join c using (p_brand) group by 1, 2""",
)


def _cells(function, step):
    def build(t):
        return rounded(aggregate.time_cells(t.events, "ts", "value", function, step, out="r"), "r")

    return build


CELL4 = "time_bucket(interval '4 hours', ts)"
CELL15 = "time_bucket(interval '15 minutes', ts)"
R.add("G3_count_per_hour", _cells("count_per_hour", 240), f"select {CELL4} as cell, round(count(value)/4.0,6) as r from events group by 1")
R.add("G3_count_per_min", _cells("count_per_min", 15), f"select {CELL15} as cell, round(count(value)/15.0,6) as r from events group by 1")
R.add(
    "G3_time_per_count",
    _cells("time_per_count", 240),
    f"select {CELL4} as cell, round(14400.0/count(value),6) as r from events group by 1",
)
R.add(
    "G4_G5_cell_shape",
    lambda t: rounded(aggregate.time_cells(t.events, "ts", "value", "iqr", 240, out="iqr"), "iqr")
    .join(rounded(aggregate.time_cells(t.events, "ts", "value", "std", 240, out="sd"), "sd"), "cell"),
    f"select {CELL4} as cell, round(quantile_cont(value,0.75)-quantile_cont(value,0.25),6) as iqr, round(stddev_samp(value),6) as sd from events group by 1",
)
R.add(
    "G6_calendar_heatmap",
    lambda t: rounded(
        aggregate.calendar_heatmap(t.events, "ts", "value", "mean", datetime(2023, 12, 30), datetime(2024, 2, 3), 240, "Asia/Tokyo", "r"), "r"
    ),
    """with g as (select unnest(generate_series(timestamp '2023-12-30', timestamp '2024-02-02 20:00', interval '4 hours')) as cell),
a as (select time_bucket(interval '4 hours', ts + interval '9 hours') as cell, avg(value) as r from events group by 1)
select cell, round(r, 6) as r from g left join a using (cell)""",
)
R.add(
    "G7_xy_heatmap",
    lambda t: rounded(aggregate.xy_heatmap(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity", "mean", "r"), "r"),
    "select l_returnflag, l_linenumber, round(avg(l_quantity),6) as r from lineitem group by 1, 2",
)
R.add(
    "G7_xy_heatmap_ratio",
    lambda t: rounded(aggregate.xy_heatmap(t.lineitem, "l_returnflag", "l_linenumber", "l_quantity", "ratio", "r"), "r"),
    "select l_returnflag, l_linenumber, round(count(*)*100.0/(select count(*) from lineitem),6) as r from lineitem group by 1, 2",
)
R.add(
    "G8_ng_rate",
    lambda t: rounded(aggregate.ng_rate(t.events, "value", ">", 50, ["event_type"]), "ng_rate"),
    "select event_type, round(count(*) filter (value > 50)*100.0/count(value),6) as ng_rate from events group by 1",
)
TERMS = [(datetime(2024, 1, d), datetime(2024, 1, d + 6)) for d in (1, 5, 14)]
R.add(
    "G8_ng_rate_by_terms",
    lambda t: rounded(aggregate.ng_rate_by_terms(t.events, "ts", "value", ">=", 50, TERMS), "ng_rate"),
    """with x as (select * from (values (0, timestamp '2024-01-01', timestamp '2024-01-07'), (1, timestamp '2024-01-05', timestamp '2024-01-11'),
 (2, timestamp '2024-01-14', timestamp '2024-01-20')) v(term, lo, hi))
select term, count(value) as n, round(count(*) filter (value >= 50)*100.0/count(value),6) as ng_rate from x join events on ts > lo and ts <= hi group by 1""",
)

# --- summary statistics ---

LIMITS = summary.Limits(low=5, high=45, process_low=2, process_high=48)


def _summary(t: Tables):
    """Quantity by return flag; missing where the line has no discount, unlinked (no time) for line 7."""
    df = t.lineitem.withColumns(
        {
            "x": F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")),
            "y": F.when(F.col("l_discount") > 0, F.when(F.col("l_tax") == 0.08, F.lit(float("inf"))).otherwise(F.col("l_quantity"))),
        }
    )
    out = summary.full_summary(df, "x", "y", ["l_returnflag"], LIMITS)
    kinds = dict(out.dtypes)
    keep = [c for c in out.columns if c in SUMMARY_SQL or c == "l_returnflag"]
    return out.selectExpr(*[f"round({c}, 4) AS {c}" if kinds[c] == "double" else c for c in keep])


SUMMARY_SQL = {
    "ntotal": "count(*)",
    "count_unlinked": "count(*) filter (x is null)",
    "pn_plus": "count(*) filter (f >= 45)",
    "pn_minus": "count(*) filter (f <= 5)",
    "pn": "count(*) filter (f >= 45) + count(*) filter (f <= 5)",
    "p": "round((count(*) filter (f >= 45) + count(*) filter (f <= 5))*100.0/count(*),4)",
    "pn_proc": "count(*) filter (f >= 48) + count(*) filter (f <= 2)",
    "pn_na": "count(*) filter (y is null) - count(*) filter (x is null)",
    "p_na": "round((count(*) filter (y is null) - count(*) filter (x is null))*100.0/count(*),4)",
    "pn_inf": "count(*) filter (y = 'inf')",
    "pn_total": "count(*) filter (f >= 45) + count(*) filter (f <= 5) + count(*) filter (y is null) - count(*) filter (x is null) + count(*) filter (y = 'inf')",
    "n_stats": "count(*) - (count(*) filter (y is null) - count(*) filter (x is null) + count(*) filter (y = 'inf'))",
    "average": "round(avg(f),4)",
    "sigma": "round(stddev_samp(f),4)",
    "minimum": "min(f)",
    "maximum": "max(f)",
    "cp": "round(40/(6*stddev_samp(f)),4)",
    "cpk": "round(least(45-avg(f), avg(f)-5)/(3*stddev_samp(f)),4)",
    "p5": "round(quantile_cont(f,0.05),4)",
    "p25": "round(quantile_cont(f,0.25),4)",
    "median": "round(quantile_cont(f,0.5),4)",
    "p75": "round(quantile_cont(f,0.75),4)",
    "p95": "round(quantile_cont(f,0.95),4)",
    "iqr": "round(quantile_cont(f,0.75)-quantile_cont(f,0.25),4)",
    "niqr": "round(0.7413*(quantile_cont(f,0.75)-quantile_cont(f,0.25)),4)",
    "whisker_upper": "round(quantile_cont(f,0.75)+1.5*(quantile_cont(f,0.75)-quantile_cont(f,0.25)),4)",
    "t_n_stats": "count(f)",
    "t_average": "round(avg(f),4)",
    "avg_p_3sigma": "round(avg(f)+3*stddev_samp(f),4)",
    "linked_pct": "round((count(*)-count(*) filter (x is null))*100.0/count(*),4)",
    "num_over_upper": "0::bigint",
    "mode": "(select m.f from m where m.l_returnflag = d.l_returnflag)",
}
R.add(
    "G9_full_summary",
    _summary,
    """with d as (select l_returnflag, x, y, case when y <> 'inf' then y end as f from (select l_returnflag,
  case when l_linenumber <> 7 then l_shipdate end as x,
  case when l_discount > 0 then case when l_tax = 0.08 then 'inf'::double else l_quantity end end as y from lineitem)),
m as (select l_returnflag, f from d where f is not null group by 1, 2 qualify row_number() over (partition by l_returnflag order by count(*) desc, f) = 1)
select l_returnflag, """
    + ", ".join(f"{sql} as {name}" for name, sql in SUMMARY_SQL.items())
    + " from d group by l_returnflag",
)


def _trimmed(t: Tables):
    """Values of the event stream are long-tailed, so trimming and overflow counts bite."""
    out = summary.full_summary(t.events, "ts", "value", ["event_type"], summary.Limits(low=1, high=100, act_from=datetime(2024, 1, 5), act_to=datetime(2024, 1, 20)))
    cols = ["t_average", "t_sigma", "t_cpk", "t_maximum", "lower_range", "upper_range"]
    return rounded(out.select("event_type", "ntotal", "t_n_stats", "num_over_upper", "num_over_lower", *cols), *cols, digits=4)


R.add(
    "G11_G12_G13_trimmed_summary",
    _trimmed,
    """with d as (select event_type, value from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'),
q as (select event_type, quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3 from d group by 1),
t as (select event_type, count(*) as ntotal, count(*) filter (k) as t_n_stats, avg(value) filter (k) as ta, stddev_samp(value) filter (k) as ts, max(value) filter (k) as tm,
 min(q1-2.5*(q3-q1)) as lo, max(q3+2.5*(q3-q1)) as hi from (select d.*, q1, q3, value between q1-2.5*(q3-q1) and q3+2.5*(q3-q1) as k from d join q using (event_type)) group by 1),
s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as r, count(*) over (partition by event_type) - 1 as n from events),
m as (select event_type, avg(value) filter (r in (floor(n*0.25), ceil(n*0.25))) as m1, avg(value) filter (r in (floor(n*0.75), ceil(n*0.75))) as m3 from s group by 1),
o as (select event_type, count(*) filter (value > m3+4.5*(m3-m1)) as num_over_upper, count(*) filter (value < m1-4.5*(m3-m1)) as num_over_lower from events join m using (event_type) group by 1)
select event_type, ntotal, t_n_stats, num_over_upper, num_over_lower, round(ta,4) as t_average, round(ts,4) as t_sigma,
 round(least(100-ta, ta-1)/(3*ts),4) as t_cpk, round(tm,4) as t_maximum, round(lo,4) as lower_range, round(hi,4) as upper_range from t join o using (event_type)""",
)
R.add(
    "G10_mode",
    lambda t: modes(t.lineitem, "l_quantity", ["l_returnflag"]),
    "select l_returnflag, l_quantity as mode from lineitem group by 1, 2 qualify row_number() over (partition by l_returnflag order by count(*) desc, l_quantity) = 1",
)


def _ranges(t: Tables):
    over, axis = summary.overflow_bounds(t.events, "value"), summary.axis_range(t.events, "value")
    df = t.events.agg(
        F.count_if(F.col("value") < over[0]).alias("below"), F.count_if(F.col("value") > over[1]).alias("above")
    )
    return df.withColumns({n: F.lit(round(v, 4)) for n, v in zip(("axis_low", "axis_high"), axis)})


MID_SQL = """with s as (select value, row_number() over (order by value) - 1 as r, count(*) over () - 1 as n from events),
m as (select avg(value) filter (r in (floor(n*0.25), ceil(n*0.25))) as q1, avg(value) filter (r in (floor(n*0.75), ceil(n*0.75))) as q3 from s)"""
R.add(
    "G13_G14_midpoint_ranges",
    _ranges,
    MID_SQL
    + " select count(*) filter (value < q1-4.5*(q3-q1)) as below, count(*) filter (value > q3+4.5*(q3-q1)) as above,"
    " round(any_value(q1-2.5*(q3-q1)),4) as axis_low, round(any_value(q3+2.5*(q3-q1)),4) as axis_high from events, m",
)
R.add(
    "G15_scales",
    lambda t: rounded(summary.scales(t.lineitem, ["l_quantity", "l_extendedprice"], {"l_quantity": summary.Limits(10, 40, 5, 45)}), "y_min", "y_max", digits=4),
    """with q as (select quantile_cont(l_extendedprice,0.25) a, quantile_cont(l_extendedprice,0.75) b, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem),
f as (select greatest(0, a-2.5*(b-a)) lo, b+2.5*(b-a) hi, a-2.5*(b-a) clo, b+2.5*(b-a) chi from q),
z as (select quantile_cont(l_quantity,0.25) a, quantile_cont(l_quantity,0.75) b from lineitem),
y as (select greatest(0, a-2.5*(b-a)) lo, b+2.5*(b-a) hi, a-2.5*(b-a) clo, b+2.5*(b-a) chi from z),
c as (select least(min(l_extendedprice), min(l_quantity)) lo, greatest(max(l_extendedprice), max(l_quantity)) hi from lineitem)
select 'l_extendedprice' as variable, s as scale, round(f.lo,4) as y_min, round(f.hi,4) as y_max,
 (select count(*) from lineitem where l_extendedprice < clo) as lower_outliers, (select count(*) from lineitem where l_extendedprice > chi) as upper_outliers
 from f, (values ('auto'),('setting'),('threshold')) v(s)
union all select 'l_quantity', 'auto', round(lo,4), round(hi,4), (select count(*) from lineitem where l_quantity < clo), (select count(*) from lineitem where l_quantity > chi) from y
union all select 'l_quantity', 'setting', 5, 45, (select count(*) from lineitem where l_quantity < 5), (select count(*) from lineitem where l_quantity > 45)
union all select 'l_quantity', 'threshold', 10, 40, (select count(*) from lineitem where l_quantity < 7), (select count(*) from lineitem where l_quantity > 43)
union all select v, 'common', lo, hi, 0, 0 from c, (values ('l_quantity'),('l_extendedprice')) w(v)
union all select 'l_extendedprice', 'full', min(l_extendedprice), max(l_extendedprice), 0, 0 from lineitem
union all select 'l_quantity', 'full', min(l_quantity), max(l_quantity), 0, 0 from lineitem""",
)

# --- histograms and densities ---

R.add(
    "G16_histogram",
    lambda t: density.histogram(t.events, "value", 100, keys=["event_type"]).select("event_type", "bin", "n"),
    """with m as (select min(value) lo, max(value) hi from events),
b as (select event_type, least(floor((value-lo)*(100/(hi-lo))), 99)::int as bin, count(*) as n from events, m group by 1, 2)
select event_type, bin, coalesce(n, 0) as n from (select event_type, unnest(range(100))::int as bin from (select distinct event_type from events)) left join b using (event_type, bin)""",
)
GRID = [float(v) for v in range(0, 101, 10)]
KDE_SQL = """with s as (select {key} count(value) n, stddev_pop(value) sd, quantile_cont(value,0.75)-quantile_cont(value,0.25) iqr from events {group}),
h as (select {key} n, 1.06*(case when iqr = 0 then sd else least(sd, iqr/1.34) end)*pow(n,-0.2) as h from s),
g as (select (x*10)::double as grid from range(11) r(x))
select {key} grid, round({height}*sum(exp(-0.5*pow((grid-value)/h,2)))/(any_value(n)*any_value(h)*sqrt(2*pi())),8) as density
from events {join}, g group by {key} grid"""
R.add(
    "G17_kernel_density",
    lambda t: rounded(density.kernel_density(t.events, "value", GRID), "density", digits=8),
    KDE_SQL.format(key="", group="", height="1", join=", h"),
)
R.add(
    "G18_ridgeline",
    lambda t: rounded(density.ridgeline(t.events, "value", ["event_type"], (0.0, 100.0), 11).drop("share"), "density", digits=8),
    KDE_SQL.format(key="event_type,", group="group by event_type", height="3", join="join h using (event_type)"),
)
R.add(
    "G18_ridgeline_own_bounds",
    lambda t: rounded(density.ridgeline(t.events, "value", ["event_type"]), "grid", "density", "share", digits=7),
    """with s as (select event_type, count(value) n, avg(value) m, stddev_pop(value) sd, quantile_cont(value,0.75)-quantile_cont(value,0.25) iqr from events group by 1),
h as (select event_type, n, 1.06*(case when iqr = 0 then sd else least(sd, iqr/1.34) end)*pow(n,-0.2) as h from s),
b as (select min(m-2.5*sd) as lo, max(m+2.5*sd) as hi from s),
g as (select lo + i*((hi-lo)/127) as grid from b, range(128) r(i)),
w as (select event_type, value, count(*) as w from events where value is not null group by 1, 2),
d as (select event_type, grid, 3*sum(w*exp(-0.5*pow((grid-value)/h,2)))/(any_value(n)*any_value(h)*sqrt(2*pi())) as d from w join h using (event_type), g group by 1, 2)
select event_type, round(grid,7) as grid, round(d,7) as density, round(d/max(d) over (partition by event_type),7) as share from d""",
)


def _emd_sql(ref, signed=True):
    total = "sum((p-q)*(bin+1))" if signed else "sum(abs(run))"
    return f"""with m as (select min(value) lo, max(value) hi from events),
c as (select event_type, least(floor((value-lo)*(100/(hi-lo))), 99)::int as bin, count(*) as n from events, m group by 1, 2),
t as (select event_type, sum(n) as s, row_number() over (order by event_type) as g from c group by 1),
d as (select event_type, g, bin, coalesce(n,0)/s as p from t cross join (select unnest(range(100))::int as bin) b left join c using (event_type, bin)),
e as (select d.*, r.p as q, sum(r.p - d.p) over (partition by d.event_type order by d.bin) as run from d join d r on r.bin = d.bin and r.g = {ref})
select event_type, round({total}/99*any_value(hi-lo), 6) as emd from e, m group by 1"""


R.add(
    "G19_emd_drift",
    lambda t: rounded(density.emd(t.events, "value", "event_type"), "emd"),
    _emd_sql("1"),
)
R.add(
    "G19_emd_diff",
    lambda t: rounded(density.emd(t.events, "value", "event_type", diff=True), "emd"),
    _emd_sql("greatest(d.g-1, 1)"),
)
R.add(
    "G19_emd_exact",
    lambda t: rounded(density.emd(t.events, "value", "event_type", signed=False), "emd"),
    _emd_sql("1", False),
)


def _emd_ng(t: Tables):
    rates = aggregate.ng_rate(t.events, "value", ">", 50, ["event_type"])
    return rounded(density.emd_with_ng(t.events, ["value"], "event_type", rates), "emd", "ng_rate")


R.add(
    "G20_emd_with_ng_rate",
    _emd_ng,
    "select event_type, 'value' as variable, emd, round(count(*) filter (value > 50)*100.0/count(value),6) as ng_rate from ("
    + _emd_sql("1")
    + ") e join events using (event_type) group by event_type, emd",
)
R.add(
    "G21_hourly_counts",
    lambda t: aggregate.hourly_counts(t.events, "ts", ["event_type"]),
    "select event_type, date_trunc('hour', ts)::timestamp as hour, count(*) as n from events group by 1, 2",
)
R.add(
    "G22_count_calendar",
    lambda t: aggregate.count_calendar(aggregate.hourly_counts(t.events, "ts"), datetime(2024, 1, 1), datetime(2024, 2, 10), "month"),
    """select slot::timestamp as slot, coalesce(n, 0)::bigint as n from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-02-09', interval '1 day')) as slot)
left join (select date_trunc('day', ts)::timestamp as slot, count(*) as n from events group by 1) using (slot)""",
)

# --- co-occurrence ---

KINDS = ["click", "error", "purchase", "signup", "view"]


def _alarms(t: Tables):
    """Event types as count columns."""
    return t.events.select("ts", *[F.when(F.col("event_type") == k, 1).otherwise(0).alias(k) for k in KINDS])


R.add(
    "G23_pareto",
    lambda t: rounded(aggregate.pareto(_alarms(t), KINDS), "ratio"),
    """with c as (select event_type as name, count(*)::double as total from events group by 1)
select name, total, round(sum(total) over (order by total desc, name)/sum(total) over (),6) as ratio,
 sum(total) over (order by total desc, name)/sum(total) over () <= 0.8 as highlight from c""",
)
CO_SQL = """with h as (select date_trunc('{unit}', ts) b, event_type k, count(*) n from events group by 1, 2),
n as (select distinct event_type k from events)
select n1.k as source, n2.k as target, coalesce(sum(least(coalesce(a.n,0), coalesce(b.n,0))),0)::double as weight from n n1 join n n2 on n1.k < n2.k
left join h a on a.k = n1.k left join h b on b.k = n2.k and b.b = a.b group by 1, 2"""
R.add("G24_co_occurrence_hour", lambda t: aggregate.co_occurrence(_alarms(t), "ts", KINDS, "hour"), CO_SQL.format(unit="hour"))
R.add("G24_co_occurrence_day", lambda t: aggregate.co_occurrence(_alarms(t), "ts", KINDS, "day"), CO_SQL.format(unit="day"))
R.add(
    "G24_node_sizes",
    lambda t: aggregate.node_sizes(_alarms(t), KINDS),
    "select event_type as name, count(*)::double as size from events group by 1",
)
R.add(
    "G25_strongest_edges",
    lambda t: aggregate.strongest_edges(aggregate.co_occurrence(_alarms(t), "ts", KINDS, "hour"), 30),
    "select * from (" + CO_SQL.format(unit="hour") + ") order by weight desc, source, target limit 3",
)
R.add(
    "G26_invalid_counts",
    lambda t: aggregate.invalid_counts(t.lineitem.select("l_quantity", "l_tax", "l_returnflag"), ["l_quantity", "l_tax", "l_returnflag"]),
    """select 'l_quantity' as "column", count(*) filter (l_quantity < 0 or floor(l_quantity) <> l_quantity) as errors from lineitem
union all select 'l_tax', count(*) filter (l_tax < 0 or floor(l_tax) <> l_tax) from lineitem
union all select 'l_returnflag', count(*) from lineitem""",
)

FENCE = """with s as (select {c} as v, row_number() over (order by {c}) - 1 as r, count(*) over () - 1 as n from lineitem),
m as (select min(v) lo, max(v) hi, avg(v) filter (r in (floor(n*0.25), ceil(n*0.25))) as q1, avg(v) filter (r in (floor(n*0.75), ceil(n*0.75))) as q3 from s)
select least(lo, q1-2.5*(q3-q1)) as lo, greatest(hi, q3+2.5*(q3-q1)) as hi from m"""
R.add(
    "G27_histogram_2d",
    lambda t: density.histogram_2d(t.lineitem, "l_extendedprice", "l_quantity", 20)[0],
    f"""select least(floor((l_extendedprice-x.lo)*(20/(x.hi-x.lo))),19)::int as bx, least(floor((l_quantity-y.lo)*(20/(y.hi-y.lo))),19)::int as by, count(*) as n
from lineitem, ({FENCE.format(c='l_extendedprice')}) x, ({FENCE.format(c='l_quantity')}) y group by 1, 2""",
)
def _hours(t: Tables):
    return t.events.withColumn("hour", F.hour("ts").cast("double"))


def _midpoints(col: str) -> str:
    place = lambda q: f"(l[floor((len(l)-1)*{q})::int+1] + l[ceil((len(l)-1)*{q})::int+1])/2"
    return f"select l[1] as mn, l[len(l)] as mx, {place(0.25)} as q1, {place(0.75)} as q3 from (select list_sort(list({col})) as l from v)"


_DENSITY = f"""with v as (select event_id, value as x, hour(ts)::double as y from events where value is not null),
rx as (select least(mn, q1-2.5*(q3-q1)) as lo, greatest(mx, q3+2.5*(q3-q1)) as hi from ({_midpoints("x")})),
ry as (select least(mn, q1-2.5*(q3-q1)) as lo, greatest(mx, q3+2.5*(q3-q1)) as hi from ({_midpoints("y")})),
s as (select count(*)::double as n, pow(count(*), -1/3.0::double) as f, var_samp(x) as vx, var_samp(y) as vy, covar_samp(x, y) as c from v),
k as (select n, vx*f as a, vy*f as b, c*f as c, vx*f*vy*f - c*f*c*f as det from s),
p as (select x, y, count(*)::double as w from v group by 1, 2),
g as (select i, j, rx.lo + i*((rx.hi-rx.lo)/20) as gx, ry.lo + j*((ry.hi-ry.lo)/20) as gy from rx, ry, range(21) a(i), range(21) b(j)),
d as (select i, j, gx, gy, sum(w*exp(-0.5*(k.b*(gx-x)*(gx-x) - 2*k.c*(gx-x)*(gy-y) + k.a*(gy-y)*(gy-y))/k.det)) as d from g, p, k group by 1, 2, 3, 4)"""

R.add(
    "G28_contour",
    lambda t: rounded(density.contour(_hours(t), "value", "hour", 20), "gx", "gy", "z"),
    f"{_DENSITY} select round(gx, 6) as gx, round(gy, 6) as gy, round(ln(1000*d/(select max(d) from d)+1), 6) as z from d",
)
R.add(
    "G28_sparse_points",
    lambda t: density.sparse_points(_hours(t), "value", "hour", 20).select("event_id", "low_density"),
    f"""{_DENSITY},
c as (select event_id, case when x is not null then least(floor((x-rx.lo)*(20/(rx.hi-rx.lo))), 19)::int end as i, least(floor((y-ry.lo)*(20/(ry.hi-ry.lo))), 19)::int as j
  from (select event_id, value as x, hour(ts)::double as y from events), rx, ry),
n as (select i, j, count(*) as n from c where i is not null group by 1, 2),
m as (select a.i, a.j, (a.d+b.d+e.d+f.d)/4 as d from d a join d b on b.i=a.i+1 and b.j=a.j join d e on e.i=a.i and e.j=a.j+1 join d f on f.i=a.i+1 and f.j=a.j+1),
o as (select i, j, coalesce(sum(n) over (order by d, i*20+j rows between unbounded preceding and 1 preceding), 0) as before from m join n using (i, j))
select event_id, coalesce(o.before <= (select floor(sum(n)*0.05) from n), false) as low_density from c left join o using (i, j)""",
)

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(t: Tables):
    df = t.lineitem.withColumn("l_tax", F.when(F.col("l_linenumber") < 5, F.col("l_tax")))
    return rounded(multivariate.pair_correlations(df, NUMBERS), "corr", digits=8)


_tax = "case when l_linenumber < 5 then l_tax end"
R.add(
    "G29_correlations",
    _pairs,
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {_tax if b == 'l_tax' else b}),8) as corr,"
        f" count({_tax if b == 'l_tax' else b}) as n from lineitem"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    ),
)
R.add(
    "G29_partial_correlations",
    lambda t: rounded(multivariate.partial_correlations(t.lineitem, ["l_quantity", "l_discount", "l_tax"]), "pcorr", digits=8),
    " union all ".join(
        f"select '{a}' as a, '{b}' as b, round((corr({a},{b})-corr({a},{c})*corr({b},{c}))/sqrt((1-pow(corr({a},{c}),2))*(1-pow(corr({b},{c}),2))),8) as pcorr from lineitem"
        for a, b, c in (
            ("l_quantity", "l_discount", "l_tax"),
            ("l_quantity", "l_tax", "l_discount"),
            ("l_discount", "l_tax", "l_quantity"),
        )
    ),
)


def _matrix(t: Tables):
    """All pairs of a scatter matrix as occupied cells."""
    cols, out = ["l_quantity", "l_discount", "l_tax"], None
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            cells, _ = density.histogram_2d(t.lineitem, a, b, 10)
            part = cells.select(F.lit(a).alias("x"), F.lit(b).alias("y"), "bx", "by", "n")
            out = part if out is None else out.unionByName(part)
    return out


R.add(
    "G30_scatter_matrix",
    _matrix,
    " union all ".join(
        f"(select '{a}' as x, '{b}' as y, least(floor(({a}-x.lo)*(10/(x.hi-x.lo))),9)::int as bx, least(floor(({b}-y.lo)*(10/(y.hi-y.lo))),9)::int as by, count(*) as n"
        f" from lineitem, ({FENCE.format(c=a)}) x, ({FENCE.format(c=b)}) y group by 3, 4)"
        for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))
    ),
)
R.add(
    "G31_H20_most_common",
    lambda t: aggregate.keep_most_common(t.part, "p_brand", 5).select("p_partkey", "p_brand"),
    "select p_partkey, p_brand from part where p_brand in (select p_brand from part group by 1 order by count(*) desc, p_brand limit 5)",
)
R.add(
    "G32_distinct_counts",
    lambda t: aggregate.distinct_counts(t.part, ["p_brand", "p_type", "p_size"]),
    """select 'p_brand' as "column", count(distinct p_brand) as n from part union all select 'p_type', count(distinct p_type) from part
union all select 'p_size', count(distinct p_size) from part""",
)
R.add(
    "G33_record_count",
    lambda t: t.lineitem.agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("serials")),
    "select count(*) as rows, count(distinct l_orderkey) as serials from lineitem",
)
R.add(
    "B20_abnormal_counts",
    lambda t: rounded(
        cleaning.abnormal_counts(
            t.lineitem.withColumn("v", F.when(F.col("l_linenumber") == 1, F.lit(9999.5)).otherwise(F.col("l_extendedprice"))), "v"
        ),
        "ratio",
    ),
    """with v as (select case when l_linenumber = 1 then 9999.5 else l_extendedprice end as value from lineitem),
c as (select value, count(*) n from v group by 1),
r as (select value, n, (n+1)/((coalesce(lag(n) over (order by value),0)+coalesce(lead(n) over (order by value),0))*0.5+1) as ratio from c)
select value, n, round(ratio,6) as ratio from r where ratio > 50 order by ratio desc, value limit 2""",
)
