"""E1-E18 predicates and duplicates, F200-F210 derived columns, I1-I5 set operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rnd
from millrace.bindings.links import SQL_ID, lineitem_with_id
from millrace.operators import derive, filters, masters
from millrace.plans import importer
from millrace.sources import files, tables
from millrace.spec import DuplicateShow, FilterSpec

R = Registry()
Fs = FilterSpec


def _part(name, groups, sql):
    R.add(name, lambda t: filters.apply_filters(t.part, groups).select("p_partkey"), f"select p_partkey from part where {sql}")


_part("E1_value_in_list", [[Fs("p_type", "matches", ("PROMO", "SMALL"))]], "p_type in ('PROMO','SMALL')")
_part("E2_starts_with", [[Fs("p_name", "startswith", ("blue",))]], "p_name like 'blue%'")
_part("E2_ends_with", [[Fs("p_name", "endswith", ("bolt",))]], "p_name like '%bolt'")
_part("E2_contains", [[Fs("p_name", "contains", ("ll",))]], "p_name like '%ll%'")
_part("E3_substring_at", [[Fs("p_brand", "substring", ("#1",), 6)]], "substr(p_brand,6,2) = '#1'")
_part("E4_all_words", [[Fs("p_name", "and_search", ("bolt blue",))]], "p_name like '%bolt%' and p_name like '%blue%'")
_part("E4_any_word", [[Fs("p_name", "or_search", ("bolt gear",))]], "p_name like '%bolt%' or p_name like '%gear%'")
_part("E5_regex", [[Fs("p_brand", "regex", (r"^Brand#\d$",))]], "regexp_matches(p_brand, '^Brand#\\d$')")
_part(
    "E6_combined",
    [
        [Fs("p_type", "matches", ("PROMO",)), Fs("p_type", "startswith", ("SM",))],
        [Fs("p_name", "contains", ("ring",))],
    ],
    "(p_type = 'PROMO' or p_type like 'SM%') and p_name like '%ring%'",
)
R.add(
    "E7_time_range",
    lambda t: tables.pull(t.events, "ts", (datetime(2024, 1, 10), datetime(2024, 1, 12))).select("event_id"),
    "select event_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'",
)


def _with_specials(t: Tables):
    """Values with NULLs and infinities in place of some event types."""
    v = (
        F.when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_type") == "signup", F.lit(float("inf")))
        .otherwise(F.floor("value"))
    )
    return t.events.withColumn("v", v.cast("double"))


R.add(
    "E8_on_demand_filter",
    lambda t: filters.on_demand(_with_specials(t), {"v": [10.0, 11.0, None], "user_id": list(range(1, 40))}).select("event_id"),
    "select event_id from events where user_id between 1 and 39 and (event_type in ('error','signup') or floor(value) in (10,11))",
)

RULES = {
    "O6M": (0.25, 2.5, "x < lo or x > hi"),
    "O6I": (0.25, 2.5, "x > lo and x < hi"),
    "O6U": (0.25, 2.5, "x < hi"),
    "O6L": (0.25, 2.5, "x > lo"),
    "O4M": (0.25, 1.5, "x < lo or x > hi"),
    "O4I": (0.25, 1.5, "x > lo and x < hi"),
    "O4U": (0.25, 1.5, "x < hi"),
    "O4L": (0.25, 1.5, "x > lo"),
    "OP1": (0.01, 0.0, "x < lo or x > hi"),
    "OP5": (0.05, 0.0, "x < lo or x > hi"),
}


def _outliers(rule):
    def build(t):
        df = filters.remove_outliers(t.events.select("event_id", "value"), ["value"], rule)
        return df.agg(F.count("value").alias("kept"), rnd(F.sum("value"), 2).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))

    return build


for _rule, (_share, _reach, _cond) in RULES.items():
    R.add(
        f"E9_outliers_{_rule}",
        _outliers(_rule),
        f"""with q as (select quantile_cont(value,{_share}) a, quantile_cont(value,{1 - _share}) b from events),
l as (select a-{_reach}*(b-a) as lo, b+{_reach}*(b-a) as hi from q),
k as (select case when {_cond} then null else x end as v from (select value as x from events), l)
select count(v) as kept, round(sum(v),2) as total, min(v) as low, max(v) as high from k""",
    )
R.add(
    "E10_drop_serial_duplicates",
    lambda t: filters.drop_serial_duplicates(t.events, ["user_id"], ["ts", "event_id"], DuplicateShow.LAST).select("user_id", "event_id"),
    "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1",
)


def _repeats(t: Tables):
    """Records of one part and quantity repeat; the last one stays, the others are set aside."""
    df = lineitem_with_id(t).select("l_id", "l_partkey", "l_quantity", "l_shipdate")
    kept, dropped = importer.repeated_rows(df, ["l_partkey", "l_quantity"], ["l_shipdate", "l_id"])
    return kept.select("l_id", F.lit(True).alias("kept")).unionByName(dropped.select("l_id", F.lit(False).alias("kept")))


R.add(
    "E11_repeated_rows",
    _repeats,
    f"select l_id, rn = 1 as kept from (select {SQL_ID} as l_id, row_number() over (partition by l_partkey, l_quantity"
    f" order by l_shipdate desc, {SQL_ID} desc) rn from lineitem)",
)
R.add(
    "E12_distinct_by_key",
    lambda t: importer.distinct_by(lineitem_with_id(t).select("l_id", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], ["l_id"]),
    f"select l_partkey, l_suppkey, min({SQL_ID}) as l_id from lineitem group by 1, 2",
)


def _not_stored(t: Tables):
    """A second delivery whose first half is stored already; NULL equals NULL."""
    ev = t.events_gap.select("event_id", "ts", "user_id", "v")
    stored = ev.where(F.col("user_id") < 75)
    return importer.not_stored(ev, stored, "ts", ["event_id", "ts", "user_id", "v"])


R.add(
    "E13_not_stored",
    _not_stored,
    "select event_id, ts, user_id, case when event_type <> 'error' then value end as v from events where user_id >= 75",
)
R.add(
    "E14_stored_duplicates",
    lambda t: importer.stored_duplicates(lineitem_with_id(t), "l_id", ["l_partkey", "l_suppkey", "l_quantity"]),
    f"select {SQL_ID} as id, count(*) over w as copies, {SQL_ID} = min({SQL_ID}) over w as keep from lineitem"
    " window w as (partition by l_partkey, l_suppkey, l_quantity) qualify count(*) over w > 1",
)


def _merge(t: Tables, what: int):
    df = lineitem_with_id(t)
    cols = ["l_id", "l_partkey", "l_quantity", "l_tax"]
    left = df.where(F.col("l_returnflag") == "A").select(*cols)
    right = df.where(F.col("l_returnflag") == "R").select(*cols[:2], F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("l_quantity"), "l_tax")
    return importer.merge_one_to_one(left, right, ["l_partkey"], ["l_id"], ["l_id"])[what]


MERGE_SQL = f"""
with a as (select {SQL_ID} as l_id, l_partkey, l_quantity, l_tax, row_number() over (partition by l_partkey order by {SQL_ID}) rn
  from lineitem where l_returnflag = 'A'),
r as (select {SQL_ID} as l_id, l_partkey, case when l_quantity > 25 then l_quantity end as l_quantity, l_tax,
  row_number() over (partition by l_partkey order by {SQL_ID}) rn from lineitem where l_returnflag = 'R')
"""
R.add(
    "E15_one_to_one_merge",
    lambda t: _merge(t, 0),
    MERGE_SQL + "select r.l_id, a.l_partkey, coalesce(r.l_quantity, a.l_quantity) as l_quantity, r.l_tax from a join r using (l_partkey, rn)",
)
R.add(
    "E15_left_over",
    lambda t: _merge(t, 1),
    MERGE_SQL + "select l_id, l_partkey, l_quantity, l_tax from a where not exists (select 1 from r where r.l_partkey = a.l_partkey and r.rn = a.rn)",
)
R.add(
    "E15_right_over",
    lambda t: _merge(t, 2),
    MERGE_SQL + "select l_id, l_partkey, l_quantity, l_tax from r where not exists (select 1 from a where r.l_partkey = a.l_partkey and r.rn = a.rn)",
)


def _flags(t: Tables):
    kind = F.when(F.col("l_linestatus") == "O", "v2_measurement").otherwise("efa_history")
    table = F.create_map(*[F.lit(x) for k in importer.FLAGS for x in (k, importer.current_flag(k))])
    done = F.create_map(*[F.lit(x) for k in importer.FLAGS for x in (k, importer.done_flag(k))])
    df = t.lineitem.select(kind.alias("kind"))
    return df.select(F.element_at(table, F.col("kind")).alias("flag"), F.element_at(done, F.col("kind")).alias("done")).groupBy("flag", "done").agg(F.count("*").alias("n"))


R.add(
    "E16_merge_flags",
    _flags,
    "select case when l_linestatus = 'O' then 1 else 8 end::int as flag, case when l_linestatus = 'O' then 3 else 12 end::int as done, count(*) as n from lineitem group by 1, 2",
)
R.add(
    "E17_retention",
    lambda t: importer.retention(t.orders, "o_orderdate", datetime(1999, 1, 1)).select("o_orderkey"),
    "select o_orderkey from orders where o_orderdate >= timestamp '1999-01-01'",
)
R.add(
    "E18_filter_catalogue",
    lambda t: filters.filter_catalogue(t.part, ["p_brand", "p_type"]),
    'select distinct \'p_brand\' as "column", p_brand as "value" from part union all select distinct \'p_type\', p_type from part',
)
R.add(
    "D28_matched_filter_values",
    lambda t: filters.matched_values(t.events, "event_type", ["click", "view", "refund"]),
    "select v as value, v in (select event_type from events) as found from (values ('click'),('view'),('refund')) x(v)",
)

# --- derived columns ---

R.add(
    "F200_category_rank",
    lambda t: derive.category_rank(t.part, "p_brand", "rank").select("p_partkey", "rank"),
    "select p_partkey, dense_rank() over (order by p_brand) as rank from part",
)


def _codes(t):
    df = t.events.withColumn("c", F.when(F.col("event_type") != "error", F.col("event_type")))
    return derive.category_codes(df, "c", "code").select("event_id", "code")


R.add(
    "F201_category_codes",
    _codes,
    "select event_id, case event_type when 'click' then 0 when 'purchase' then 1 when 'signup' then 2 when 'view' then 3 else -1 end::bigint as code from events",
)
R.add(
    "F202_discretise",
    lambda t: derive.discretise(t.lineitem, "l_extendedprice", 10, "d").select("l_orderkey", "l_linenumber", rnd("d", 4).alias("d")),
    """with m as (select min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem),
b as (select l_orderkey, l_linenumber, l_extendedprice as x, least(floor((l_extendedprice-lo)/((hi-lo)/10)), 9) as k from lineitem, m)
select l_orderkey, l_linenumber, round(avg(x) over (partition by k), 4) as d from b""",
)


def _cycle_sql(part):
    over = f"partition by {part} " if part else ""
    key = f"{part}, " if part else ""
    grouped = f"group by {part}" if part else ""
    join = f"using ({part})" if part else "on true"
    return f"""with g as (select {key}event_id, nullif((epoch_us(lead(ts) over ({over}order by ts, event_id)) - epoch_us(ts))/1e6, 0) as ct from events),
m as (select {key}quantile_cont(ct, 0.5) as med from g {grouped})
select event_id, round(case when ct < 5*med then ct end, 6) as cycle_time from g join m {join}"""


R.add(
    "F203_cycle_time",
    lambda t: derive.cycle_time(t.events, "ts", "event_id").select("event_id", rnd("cycle_time").alias("cycle_time")),
    _cycle_sql(""),
)
R.add(
    "F203_cycle_time_per_facet",
    lambda t: derive.cycle_time(t.events, "ts", "event_id", ["event_type"]).select("event_id", rnd("cycle_time").alias("cycle_time")),
    _cycle_sql("event_type"),
)
R.add(
    "F204_elapsed",
    lambda t: derive.elapsed_seconds(t.events, "ts").select("event_id", rnd("elapsed").alias("elapsed")),
    "select event_id, round((epoch_us(ts) - (select min(epoch_us(ts)) from events))/1e6, 6) as elapsed from events",
)
R.add(
    "F205_value_ranking",
    lambda t: derive.value_counts(t.part, "p_brand", 10),
    "select p_brand as value, count(*) as n from part group by 1 order by n desc, value limit 10",
)


def _facets(t):
    df = t.events.withColumn("c", F.when(F.col("event_type") != "error", F.col("event_type")))
    return derive.combination_label(df, ["c", "user_id"]).groupBy("facet").agg(F.count("*").alias("n"))


R.add(
    "F206_combination_label",
    _facets,
    "select case when event_type = 'error' then 'NA' else event_type end || ' | ' || user_id as facet, count(*) as n from events group by 1",
)
R.add(
    "F207_label_by_mean",
    lambda t: derive.label_by_statistic(t.lineitem, "l_linenumber", "l_extendedprice").select("l_linenumber", rnd("stat", 4).alias("stat"), "code"),
    "select l_linenumber, round(avg(l_extendedprice),4) as stat, row_number() over (order by avg(l_extendedprice)) - 1 as code from lineitem group by 1",
)
R.add(
    "F207_label_by_median_ordinal",
    lambda t: derive.label_by_statistic(t.lineitem, "l_linenumber", "l_extendedprice", "median", False).select("l_linenumber", rnd("stat", 4).alias("stat"), "code"),
    "select l_linenumber, round(quantile_cont(l_extendedprice,0.5),4) as stat, row_number() over (order by l_linenumber) - 1 as code from lineitem group by 1",
)
R.add(
    "F208_others",
    lambda t: derive.others(t.part, "p_brand", "brand").groupBy("brand").agg(F.count("*").alias("n")),
    """with c as (select p_brand, row_number() over (order by count(*) desc, p_brand) rn from part group by 1)
select case when rn <= 8 then p_brand else 'Other' end as brand, count(*) as n from part join c using (p_brand) group by 1""",
)
R.add(
    "F209_significant_digits",
    lambda t: t.customer.select("c_custkey", rnd(derive.significant(F.col("c_acctbal")), 6).alias("shown")),
    """select c_custkey, round(case when c_acctbal = 0 then c_acctbal else round_even(c_acctbal*pow(10, 3-floor(log10(abs(c_acctbal)))), 0)
 / pow(10, 3-floor(log10(abs(c_acctbal)))) end, 6) as shown from (select c_custkey, c_acctbal from customer where c_acctbal <> 0)
union all select c_custkey, c_acctbal from customer where c_acctbal = 0""",
)
R.add(
    "F210_filter_choices",
    lambda t: filters.choices(t.part, ["p_brand", "p_type"], {"p_size": [1, 2, 3, 4, 5]}),
    'select distinct \'p_brand\' as "column", p_brand as "value" from part where p_size between 1 and 5 union all'
    " select distinct 'p_type', p_type from part where p_size between 1 and 5",
)

# --- set operations ---

HALVES = [(datetime(2024, 1, 1), datetime(2024, 1, 16)), (datetime(2024, 1, 10), datetime(2024, 2, 1))]
R.add(
    "I1_distinct_over_ranges",
    lambda t: tables.distinct_in_ranges(t.events.select("ts", "user_id", "event_type"), "ts", HALVES).groupBy("event_type").agg(F.count("*").alias("n")),
    """select event_type, count(*) as n from (select ts, user_id, event_type from events where ts < timestamp '2024-01-16'
union select ts, user_id, event_type from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-02-01') group by 1""",
)
R.add(
    "I2_concatenate_terms",
    lambda t: tables.union_shards([tables.pull(t.events, "ts", h) for h in HALVES]).groupBy("event_type").agg(F.count("*").alias("n")),
    """select event_type, count(*) as n from (select * from events where ts < timestamp '2024-01-16'
union all select * from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-02-01') group by 1""",
)


def _difference(t):
    listing = t.pages.select(F.col("url").alias("path"), F.col("page_id").alias("modified"))
    return files.new_files(listing, listing.where(F.col("modified") % 3 == 0))


R.add(
    "I3_A13_new_files",
    _difference,
    "select url as path, page_id as modified from pages p where not exists (select 1 from pages m where m.page_id % 3 = 0 and m.url = p.url and p.page_id <= m.page_id)",
)


def _restore(t):
    stored = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    saved = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), "c_mktsegment")
    return importer.union_columns(stored, saved)


R.add(
    "I4_restore_union",
    _restore,
    "select s_suppkey, s_name, s_acctbal from supplier union all select c_custkey, c_name, null from customer",
)
R.add(
    "I5_new_masters",
    lambda t: masters.new_masters(
        t.part.select("p_brand", "p_type"), t.part.where(F.col("p_size") < 10).select("p_brand", "p_type"), ["p_brand", "p_type"]
    ),
    "select distinct p_brand, p_type from part except select p_brand, p_type from part where p_size < 10",
)
