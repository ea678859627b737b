"""D17-D32 master data and link proposals, J1-J8 name rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rnd, rounded
from millrace.functions import names
from millrace.operators import autolink, links, masters
from millrace.spec import LinkKey

R = Registry()


def _star(t: Tables):
    out = masters.star_join(
        t.customer.select("c_custkey", "c_nationkey"), [(t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey")]
    )
    return out.select("c_custkey", "n_name", "r_name")


R.add(
    "D17_A15_star_join",
    _star,
    "select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
)


def _dictionary(t: Tables):
    """Brands known so far are those of small parts; the others get the next factors."""
    stored = masters.grow_dictionary(t.part.where(F.col("p_size") <= 5), "p_brand", None)
    return masters.grow_dictionary(t.part, "p_brand", stored)


DICT_SQL = """o as (select p_brand as v, row_number() over (order by p_brand) as f from (select distinct p_brand from part where p_size <= 5)),
n as (select p_brand as v, (select max(f) from o) + row_number() over (order by p_brand) as f from (select distinct p_brand from part where p_brand not in (select v from o))),
d as (select * from o union all select * from n)"""
R.add("D30_grow_dictionary", _dictionary, f"with {DICT_SQL} select v as value, f as factor from d")
R.add(
    "D30_encode_category",
    lambda t: masters.encode_category(t.part, "p_brand", _dictionary(t), "factor").select("p_partkey", "factor"),
    f"with {DICT_SQL} select p_partkey, f as factor from part join d on p_brand = v",
)


def _decode(t: Tables):
    table = masters.grow_dictionary(t.part, "p_size", None)
    coded = masters.encode_category(t.part, "p_size", table, "factor").select("p_partkey", "factor")
    return masters.decode_category(coded, "factor", table, "size", "int").select("p_partkey", "size")


R.add("D18_D32_decode_category", _decode, "select p_partkey, p_size as size from part")


def _regroup(t: Tables):
    entries = t.part.select(F.col("p_size").cast("long").alias("data_id"), F.col("p_brand").alias("value")).distinct()
    return masters.regroup_dictionary(entries, {1: 100, 2: 100, 3: 100})


R.add(
    "D31_regroup_dictionary",
    _regroup,
    """select g as group_id, p_brand as value, row_number() over (partition by g order by p_brand) as factor from
 (select distinct case when p_size in (1,2,3) then 100 else p_size end::bigint as g, p_brand from part)""",
)


def _ungroup(t: Tables):
    used = t.part.select(F.col("p_size").cast("long").alias("data_id"), F.col("p_brand").alias("value"))
    return masters.ungroup_dictionary(used, _regroup(t), {1: 100, 2: 100, 3: 100})


R.add(
    "D31_ungroup_dictionary",
    _ungroup,
    """with u as (select distinct p_size::bigint as data_id, case when p_size in (1,2,3) then 100 else p_size end::bigint as g, p_brand as value from part),
d as (select g, value, row_number() over (partition by g order by value) as f from (select distinct g, value from u))
select data_id, value, row_number() over (partition by data_id order by value) as factor, f as group_factor from u join d using (g, value)""",
)


def _plain_again(t: Tables):
    """Names are too many for a dictionary, brands are not."""
    out = []
    for column, limit in (("p_name", 20), ("p_brand", 256)):
        table = masters.grow_dictionary(t.part, column, None)
        coded = masters.encode_category(t.part, column, table, "factor").select("p_partkey", F.col("factor").alias("v"))
        rows, _ = masters.category_or_plain(coded, "v", table, limit)
        out.append(rows.select("p_partkey", F.lit(column).alias("col"), F.col("v").cast("string").alias("v")))
    return out[0].unionByName(out[1])


R.add(
    "D32_plain_beyond_limit",
    _plain_again,
    """select p_partkey, 'p_name' as col, p_name as v from part union all
select p_partkey, 'p_brand', (dense_rank() over (order by p_brand))::varchar from part""",
)


def _resolved(t: Tables, what: int):
    """Customers resolved through the nations of even number, then the regions."""
    dims = [
        (t.nation.where(F.col("n_nationkey") % 2 == 0), {"c_nationkey": "n_nationkey"}),
        (t.region.where(F.col("r_regionkey") != 3), {"n_regionkey": "r_regionkey"}),
    ]
    return masters.resolve(t.customer.select("c_custkey", "c_nationkey"), dims)[what]


R.add(
    "D19_resolve_masters",
    lambda t: _resolved(t, 0).select("c_custkey", "n_name", "r_name"),
    """select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 where n_nationkey % 2 = 0 and r_regionkey <> 3""",
)
R.add(
    "D20_unknown_masters",
    lambda t: _resolved(t, 1).select("c_custkey"),
    """select c_custkey from customer left join nation on c_nationkey = n_nationkey where n_nationkey % 2 = 1 or n_regionkey = 3""",
)


def _tolerant(t: Tables):
    """Brand names written in several ways against the stored spelling."""
    k, b = F.col("p_partkey") % 4, F.col("p_brand")
    written = F.when(k == 0, b).when(k == 1, F.upper(b)).when(k == 2, F.regexp_replace(b, "nd#", "nd #")).otherwise(F.concat(b, F.lit("?")))
    stored = t.part.select(F.col("p_brand").alias("name")).distinct()
    stored = stored.withColumn("id", F.regexp_extract("name", r"(\d+)", 1).cast("int"))
    return masters.match_masters(t.part.select("p_partkey", written.alias("name")), stored, ["name"], "id").select("p_partkey", "id")


R.add(
    "D21_tolerant_matching",
    _tolerant,
    "select p_partkey, case when p_partkey % 4 = 3 then null else replace(p_brand, 'Brand#', '')::int end as id from part",
)
R.add(
    "D22_mapping_view",
    lambda t: _star(t).select("n_name", "r_name").distinct(),
    "select distinct n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
)
R.add(
    "D23_hover_ids",
    lambda t: masters.hover_ids(t.part, "p_type", ["p_size", "p_brand"]),
    """select distinct p_type as value, 'p_size' as master, p_size::varchar as id from part union all select distinct p_type, 'p_brand', p_brand from part""",
)
R.add(
    "D27_relationship_index",
    lambda t: masters.relationship_index(t.part, {"brand_index": ["p_brand"], "kind_index": ["p_type", "p_size"]}),
    """select distinct dense_rank() over (order by p_brand) - 1 as brand_index, dense_rank() over (order by p_type, p_size::varchar) - 1 as kind_index
 from (select distinct p_brand, p_type, p_size from part)""",
)


def _point(t: Tables):
    """The clicked order and its linked line items as (item, value) rows."""
    joined = links.equi_link(t.orders, t.lineitem, [LinkKey("o_orderkey", "l_orderkey")])
    return links.point_details(joined, "o_orderkey", 7, ["o_orderstatus", "o_totalprice", "l_linenumber"])


R.add(
    "D29_point_details",
    _point,
    """with j as (select o_orderkey as id, o_orderstatus, o_totalprice, l_linenumber from orders left join lineitem on o_orderkey = l_orderkey where o_orderkey = 7)
select distinct id, 'o_orderstatus' as item, o_orderstatus as "value" from j union all select distinct id, 'o_totalprice', o_totalprice::varchar from j
union all select distinct id, 'l_linenumber', l_linenumber::varchar from j""",
)

# --- link proposals ---


def _newest(t: Tables):
    return autolink.newest_per_serial(t.events, "event_type", "user_id", "ts")


R.add(
    "D26_newest_per_serial",
    _newest,
    "select event_type as process, user_id as serial, max(ts) as date from events group by 1, 2",
)
AUTO = """r as (select event_type as process, user_id as serial, max(ts) as date from events group by 1, 2),
c as (select r.*, count(*) over (partition by serial) as k from r)"""
R.add(
    "D24_order_scores",
    lambda t: rounded(autolink.process_scores(_newest(t)), "score"),
    f"""with {AUTO}, p as (select *, row_number() over (partition by serial order by date, process desc) as o from c where k = (select max(k) from c))
select process, round(avg(o),6) as score, min(date) as "first" from p group by 1""",
)


def _ordered(method):
    def build(t):
        found = autolink.order_processes(_newest(t), method)
        return t.spark.createDataFrame([(p, i + 1) for i, p in enumerate(found)], "process string, place int")

    return build


R.add(
    "D24_order_count_keep_max",
    _ordered("count_keep_max"),
    f"""with {AUTO}, p as (select *, row_number() over (partition by serial order by date, process desc) as o from c where k = (select max(k) from c)),
s as (select process, avg(o) as score, min(date) as d from p group by 1)
select process, (row_number() over (order by score, d, process))::int as place from s""",
)
R.add(
    "D24_order_count_keep_mean",
    _ordered("count_keep_mean"),
    f"""with {AUTO}, p as (select *, row_number() over (partition by serial order by date, process desc) as o from c where k >= (select avg(k) from c)),
s as (select process, avg(o) as score, min(date) as d from p group by 1)
select process, (row_number() over (order by score, d, process))::int as place from s""",
)


def _keep_all_sql(rounds: int = 5) -> str:
    """One round per process at most: those not placed yet are scored on their most frequent serials."""
    ctes = [AUTO, "o0 as (select null::varchar as process, 0 as turn, 0 as spot where false)"]
    for i in range(1, rounds + 1):
        ctes.append(f"l{i} as (select * from c where process not in (select process from o{i - 1}))")
        ctes.append(f"p{i} as (select *, row_number() over (partition by serial order by date, process desc) as o from l{i} where k = (select max(k) from l{i}))")
        ctes.append(f"s{i} as (select process, {i} as turn, row_number() over (order by avg(o), min(date), process) as spot from p{i} group by 1)")
        ctes.append(f"o{i} as (select * from o{i - 1} union all select * from s{i})")
    return f"with {', '.join(ctes)} select process, (row_number() over (order by turn, spot))::int as place from o{rounds}"


R.add("D24_order_count_keep_all", _ordered("count_keep_all"), _keep_all_sql())
for _m, _power in (("count_reversed", 1), ("function_count_reversed", 3)):
    R.add(
        f"D24_order_{_m}",
        _ordered(_m),
        f"""with {AUTO}, p as (select *, row_number() over (partition by serial order by date desc, process desc) as o from c),
s as (select process, sum(o*pow(k,{_power})) as score, min(date) as d from p group by 1)
select process, (row_number() over (order by score desc, d, process))::int as place from s""",
    )


def _shared(t: Tables):
    return autolink.shared_serials(_newest(t), ["click", "error", "purchase", "signup", "view"])


R.add(
    "D25_shared_serials",
    _shared,
    f"""with {AUTO} select a.process as a, b.process as b, count(*) as shared from r a join r b on a.serial = b.serial and a.process < b.process group by 1, 2""",
)


def _shared_by_many(t: Tables):
    """Some hundred processes: line items by part, orders as serials."""
    rows = t.lineitem.select((F.col("l_partkey") % 400).alias("process"), F.col("l_orderkey").alias("serial")).distinct()
    found = autolink.shared_serials(rows, list(range(400)))
    return found.where("shared > 0")


R.add(
    "D25_shared_serials_of_many",
    _shared_by_many,
    """with r as (select distinct l_partkey % 400 as process, l_orderkey as serial from lineitem)
select a.process as a, b.process as b, count(*) as shared from r a join r b on a.serial = b.serial and a.process < b.process group by 1, 2""",
)


def _chains(t: Tables):
    """Processes named by event type and serial range, so that some share no serial."""
    df = t.events.withColumn("proc", F.concat("event_type", F.when(F.col("user_id") < 75, "_low").otherwise("_high")))
    rows = autolink.newest_per_serial(df, "proc", "user_id", "ts")
    ordered = autolink.order_processes(rows, "count_reversed")
    out = [(n, i, p) for n, chain in enumerate(autolink.chains(rows, ordered)) for i, p in enumerate(chain)]
    return t.spark.createDataFrame(out, "chain int, place int, process string")


R.add(
    "D25_chains",
    _chains,
    """with recursive r as (select event_type || case when user_id < 75 then '_low' else '_high' end as process, user_id as serial, max(ts) as date from events group by 1, 2),
c as (select r.*, count(*) over (partition by serial) as k from r),
p as (select *, row_number() over (partition by serial order by date desc, process desc) as o from c),
s as (select process, row_number() over (order by sum(o*k) desc, min(date), process) as at from p group by 1),
l as (select distinct a.process as a, b.process as b from r a join r b using (serial) where a.process <> b.process),
t(n, chains) as (
  select 0::bigint, []::struct(chain int, place int, process varchar)[]
  union all
  select n + 1, list_append(chains, (
    select {'chain': coalesce(f.chain, (select coalesce(max(y.chain) + 1, 0) from (select unnest(chains) as y))::int), 'place': coalesce((select count(*) from (select unnest(chains) as y) where y.chain = f.chain), 0)::int, 'process': s.process}
    from s left join lateral (select x.chain from (select unnest(chains) as x) join l on l.a = s.process and l.b = x.process order by x.place, x.chain limit 1) f on true
    where s.at = n + 1))
  from t where n < (select count(*) from s))
select x.chain, x.place, x.process from (select unnest(chains) as x from t where n = (select count(*) from s))""",
)

# --- name rules ---


def _data_names(t: Tables):
    raw = F.concat(F.lit("計測値:"), F.col("p_name"), F.lit(" ["), F.lower(F.col("p_type")), F.lit("](No."), F.col("p_size").cast("string"), F.lit(")"))
    out = names.data_name(raw, ["mm"])
    return t.part.select("p_partkey", out["name"].alias("name"), out["unit"].alias("unit"))


R.add(
    "J1_data_name",
    _data_names,
    "select p_partkey, p_name || ' No' || p_size as name, lower(p_type) as unit from part",
)


def _lines(t: Tables):
    k = F.col("s_suppkey") % 4
    n = (F.col("s_suppkey") + 1).cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("検査"), n, F.lit("号"))).when(k == 1, F.concat(F.lit("INJ ボデーCKD"), n, F.lit("号ライン")))
        .when(k == 2, F.concat(F.lit("INJ"), n, F.lit("号 組付ライン"))).otherwise(F.col("s_name"))
    )
    out = names.line_name(raw)
    return t.supplier.select("s_suppkey", out["line"].alias("line"), out["line_no"].alias("line_no"), out["outsourced"].alias("outsourced"))


R.add(
    "J2_J4_line_name",
    _lines,
    """select s_suppkey, case s_suppkey % 4 when 0 then '検査' when 1 then 'ボデーCKD' when 2 then '組付' else s_name end as line,
 case when s_suppkey % 4 < 3 then (s_suppkey+1)::varchar end as line_no, false as outsourced from supplier""",
)


def _product_lines(t: Tables):
    """Lines with a product in front, lines of the other patterns, and the longest brand or type that a line's note contains."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    line = F.concat_ws(" ", F.element_at(F.split("p_type", " "), 1))
    raw = (
        F.when(k == 0, F.concat(F.lit("X GD-P4 "), line, n, F.lit("号ライン"))).when(k == 1, F.concat(F.lit("P4H "), line, F.lit("ライン")))
        .when(k == 2, F.concat(F.lit("P4H "), line)).when(k == 3, F.concat(line, n, F.lit("号"))).when(k == 4, F.concat(F.lit("INJ"), n, F.lit("号 "), line, F.lit("ライン"))).otherwise(line)
    )
    df = t.part.select("p_partkey", names.product_line(raw).alias("r"), F.concat(F.lit("made of "), "p_type", F.lit(" for "), "p_brand").alias("note"))
    known = t.part.select(F.explode(F.array("p_brand", F.element_at(F.split("p_type", " "), 1))).alias("known"))
    out = masters.longest_contained(df, "note", known, "known", "named")
    return out.select("p_partkey", "r.product", "r.line", "r.line_no", "r.outsourced", "named")


R.add(
    "J2_C9_product_line",
    _product_lines,
    """with p as (select *, split_part(p_type, ' ', 1) as l, p_partkey % 6 as k from part),
k as (select distinct p_brand as known from part union select distinct split_part(p_type, ' ', 1) from part),
n as (select p.p_partkey, (select known from k where contains('made of ' || p.p_type || ' for ' || p.p_brand, known) order by length(known) desc, known limit 1) as named from p)
select p_partkey, case when k = 0 then 'GD-P4' when k in (1, 2) then 'P4H' end as product, l as line, case when k in (0, 3, 4) then p_size::varchar end as line_no, false as outsourced, named
from p join n using (p_partkey)""",
)


def _equipment(t: Tables):
    k = F.col("s_suppkey") % 3
    n = (F.col("s_suppkey") + 1).cast("string")
    raw = F.when(k == 0, F.concat(F.lit("油密検査機"), n, F.lit("号2ST"))).when(k == 1, F.concat(F.lit("流量検査"), n, F.lit("号機"))).otherwise("静的流量検査機")
    out, process = names.equipment_name(raw), names.process_name(raw)
    code = names.equipment_id(F.concat(F.lit("IMB-"), F.lpad(n, 4, "0"), F.lit("-2")))
    return t.supplier.select("s_suppkey", out["equip"].alias("equip"), out["equip_no"].alias("equip_no"), out["st_no"].alias("st_no"), process.alias("process"),
                             code["equip_id"].alias("equip_id"), code["station"].alias("station"))


R.add(
    "J3_equipment",
    _equipment,
    """select s_suppkey, case s_suppkey % 3 when 0 then '油密検査' when 1 then '流量検査' else '静的流量検査' end as equip,
 case when s_suppkey % 3 < 2 then (s_suppkey+1)::varchar end as equip_no, case when s_suppkey % 3 = 0 then '2' end as st_no,
 case s_suppkey % 3 when 0 then '油密検査機' || (s_suppkey+1) || '号2ST' when 1 then '流量検査' else '静的流量検査' end as process,
 'IMBX-' || lpad((s_suppkey+1)::varchar, 4, '0') as equip_id, 2::int as station from supplier""",
)


def _part_numbers(t: Tables):
    out = names.part_number(F.concat(F.lit("JP"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")))
    short = names.part_number(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    return t.part.select("p_partkey", out["part_type"].alias("part_type"), out["part_no"].alias("part_no"), short["full"].alias("short_full"))


R.add(
    "J3_part_number",
    _part_numbers,
    """select p_partkey, substr(lpad(p_partkey::varchar,10,'0'),1,6) as part_type, substr(lpad(p_partkey::varchar,10,'0'),7,3) as part_no,
 'JP000000' || lpad((p_partkey % 1000)::varchar,3,'0') || '0' as short_full from part""",
)
R.add(
    "J5_word_replacement",
    lambda t: t.part.select("p_partkey", names.replaced_words(F.col("p_type"), {"PROMO": "promotion", "ECONOMY": "low cost"}).alias("kind")),
    "select p_partkey, case p_type when 'PROMO' then 'promotion' when 'ECONOMY' then 'low cost' else p_type end as kind from part",
)


def _system(t: Tables):
    raw = F.concat(F.lit("センサ "), F.col("p_name"), F.lit(" [μm] Ω"))
    return t.part.select("p_partkey", names.system_name(raw).alias("sys"))


R.add("J6_system_name", _system, "select p_partkey, 'sensa' || replace(p_name, ' ', '') || '_um_ohm' as sys from part")
R.add(
    "J7_numbered_names",
    lambda t: masters.number_repeated_names(t.part, "p_type", "p_brand", "p_partkey").select("p_partkey", "unique_name"),
    """with r as (select *, row_number() over (partition by p_type, p_brand order by p_partkey) as rn from part)
select p_partkey, case when rn = 1 then p_brand else p_brand || '_' || lpad((rn-1)::varchar, 2, '0') end as unique_name from r""",
)


def _units(t: Tables):
    """Values in minutes and hours brought to seconds."""
    rules = t.spark.createDataFrame([("click", 60.0, 1.0, 0.0), ("view", 3600.0, 1.0, 0.0), ("error", 5.0, 9.0, -17.0)], "event_type string, conversion double, denominator double, offset double")
    joined = t.events.join(rules, "event_type", "left")
    value = names.converted_unit(F.col("value"), F.col("conversion"), F.col("denominator"), F.col("offset"))
    return joined.select("event_id", rnd(value, 6).alias("base"))


R.add(
    "J8_unit_conversion",
    _units,
    """select event_id, round(case event_type when 'click' then value*60 when 'view' then value*3600 when 'error' then value*5.0::double/9.0::double-17 end, 6) as base from events""",
)
