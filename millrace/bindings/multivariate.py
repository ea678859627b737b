"""K1-K14: principal components, sparse graphs, group-wise regression."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rounded
from millrace.operators import derive, links, multivariate as mv

R = Registry()
PAIR = ["l_quantity", "l_extendedprice"]
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TRAIN = (datetime(1996, 1, 1), datetime(1999, 1, 1))
TEST = (datetime(1999, 1, 1), datetime(2000, 1, 1))


def _train(t: Tables):
    return links.time_window(t.lineitem, "l_shipdate", *TRAIN)


def _test(t: Tables):
    return links.time_window(t.lineitem, "l_shipdate", *TEST)


TRAIN_SQL = "l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1999-01-01'"
TEST_SQL = "l_shipdate >= timestamp '1999-01-01' and l_shipdate < timestamp '2000-01-01'"

R.add(
    "K1_explained_variance",
    lambda t: rounded(mv.explained_table(t.lineitem, mv.fit_components(t.lineitem, PAIR)), "sdev", "explained", "cumulative", digits=8),
    """with c as (select corr(l_quantity, l_extendedprice) r, count(*) n from lineitem),
s as (select 1 as pc, n/(n-1)*(1+abs(r)) as v, (1+abs(r))/2*100 as e from c union all select 2, n/(n-1)*(1-abs(r)), (1-abs(r))/2*100 from c)
select pc::int as pc, round(sqrt(v),8) as sdev, round(e,8) as explained, round(sum(e) over (order by pc),8) as cumulative from s""",
)
R.add(
    "K2_components_for_share",
    lambda t: t.lineitem.agg(F.count("*").alias("n")).withColumn("components", F.lit(mv.fit_components(t.lineitem, PAIR).components_for(80))),
    """select count(*) as n, case when (1+abs(corr(l_quantity, l_extendedprice)))/2 >= 0.8 then 1 else 2 end::int as components from lineitem""",
)


def _t2q(t: Tables, rows):
    model = mv.fit_components(_train(t), PAIR)
    out = mv.t2_and_q(rows(t), model, 1)
    return rounded(out.select("l_orderkey", "l_linenumber", "t2", "q"), "t2", "q", digits=7)


def _t2q_sql(where):
    return f"""with m as (select avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) s2,
 sign(corr(l_quantity, l_extendedprice)) g from lineitem where {TRAIN_SQL}),
z as (select l_orderkey, l_linenumber, (l_quantity-m1)/s1 as a, (l_extendedprice-m2)/s2*g as b from lineitem, m where {where}),
v as (select stddev_pop((a+b)/sqrt(2.0)) as s from z)
select l_orderkey, l_linenumber, round(pow((a+b)/sqrt(2.0)/s,2),7) as t2, round(pow(a-b,2)/2,7) as q from z, v"""


R.add("K3_K5_t2_q_train", lambda t: _t2q(t, _train), _t2q_sql(TRAIN_SQL))
R.add("K3_K5_t2_q_test", lambda t: _t2q(t, _test), _t2q_sql(TEST_SQL))


def _contributions(t: Tables):
    model = mv.fit_components(_train(t), FOUR)
    out = mv.t2_and_q(_test(t), model, model.components_for(80), contributions=True)
    return out.select("l_orderkey", "l_linenumber", "t2", "q", *[F.col(f"{c}__{k}") for c in FOUR for k in ("t2", "q")])


R.add("K3_contributions", _contributions)
R.add("K4_biplot_arrows", lambda t: mv.biplot(_train(t), mv.fit_components(_train(t), FOUR))[1])


def _radii(t: Tables):
    radii, _ = mv.biplot(_train(t), mv.fit_components(_train(t), PAIR))
    rows = [(k, round(v, 8)) for k, v in radii.items()]
    return t.spark.createDataFrame(rows, "circle string, radius double")


R.add(
    "K4_biplot_circles",
    _radii,
    f"""with m as (select avg(l_quantity) m1, stddev_pop(l_quantity) s1, avg(l_extendedprice) m2, stddev_pop(l_extendedprice) s2 from lineitem where {TRAIN_SQL}),
r as (select sqrt(pow((l_quantity-m1)/s1,2)+pow((l_extendedprice-m2)/s2,2)) as r, pow((l_quantity-m1)/s1,2)+pow((l_extendedprice-m2)/s2,2) as r2 from lineitem, m where {TRAIN_SQL})
select * from (values ('sigma', 1.0::double), ('2sigma', 2.0), ('3sigma', 3.0)) v(circle, radius) union all select 'max', round(max(r),8) from r
union all select 'train', round(max(r),8) from r union all select 'percentile', round(sqrt(quantile_cont(r2,0.85)),8) from r""",
)


DIMS = 64
COORDS = [f"e{i}" for i in range(DIMS)]


def _embedded(t: Tables):
    """All embedding coordinates as columns, with sums that tie some of them together."""
    e = F.col("embedding")
    df = t.embeddings.select("vec_id", *[e[i].cast("double").alias(c) for i, c in enumerate(COORDS)])
    return df.withColumns({"mix": F.col("e0") + F.col("e1") + 0.1 * F.col("e2"), "twin": F.col("e3") - 0.2 * F.col("e4")})


EMBED = [*COORDS, "mix", "twin"]
ALPHAS = [0.05, 0.1, 0.2, 0.3]
R.add("K6_K7_sparse_graph", lambda t: mv.graph_edges(t.embeddings, mv.graphical_model(_embedded(t), EMBED, ALPHAS)))
R.add("K6_sparse_graph_target", lambda t: mv.graph_edges(t.embeddings, mv.graphical_model(_embedded(t), EMBED, [0.01, 0.05, 0.1, 0.2], "mix")))
R.add("K8_tuned_graph", lambda t: mv.graph_edges(t.embeddings, mv.tuned_graph(_embedded(t), EMBED, ["mix"])))

#: Coordinates in long form with the two sums, and the correlation of every pair, for DuckDB.
LONG_SQL = f"""v as (select vec_id, unnest(range(0, {DIMS})) as i, unnest(embedding)::double as x from embeddings),
e as (select vec_id, 'e' || i as c, x from v union all
  select vec_id, 'mix', embedding[1]::double + embedding[2]::double + 0.1 * embedding[3]::double from embeddings union all
  select vec_id, 'twin', embedding[4]::double - 0.2 * embedding[5]::double from embeddings)"""
PAIRS_SQL = f"{LONG_SQL}, r as (select a.c as a, b.c as b, corr(a.x, b.x) as r from e a join e b on a.vec_id = b.vec_id and a.c < b.c group by 1, 2)"


def _optimal_graph(shrunk: bool):
    """Every pair with its (shrunk) correlation, and whether the solution meets the optimality condition there.

    The gradient of the likelihood, inverse minus correlation, is the penalty times the sign of an edge, and at most the
    penalty where there is none.
    """

    def build(t: Tables):
        m = mv.moments(_embedded(t), EMBED)
        cov = mv.shrunk_correlation(m) if shrunk else m.corr
        alpha, rows = 0.02, []
        precision = mv.sparse_precision(cov, alpha)
        slope = np.linalg.inv(precision) - cov
        for i, a in enumerate(EMBED):
            for j, b in enumerate(EMBED):
                if a < b:
                    edge = precision[i, j]
                    good = abs(slope[i, j] - alpha * np.sign(edge)) < 1e-5 if edge else abs(slope[i, j]) <= alpha + 1e-5
                    rows.append((a, b, round(float(cov[i, j]), 8), bool(good)))
        return t.spark.createDataFrame(rows, "a string, b string, corr double, optimal boolean")

    return build


R.add("K6_optimal_graph", _optimal_graph(False), f"with {PAIRS_SQL} select a, b, round(r, 8) as corr, true as optimal from r")
R.add("K6_optimal_shrunk_graph", _optimal_graph(True), f"with {PAIRS_SQL} select a, b, round(0.2 * r, 8) as corr, true as optimal from r")
R.add(
    "K1_G29_all_pairs",
    lambda t: rounded(mv.pair_correlations(_embedded(t), sorted(EMBED)), "corr", digits=8),
    f"with {PAIRS_SQL} select a, b, round(r, 8) as corr, (select count(*) from embeddings) as n from r",
)
# in code point order, as the pairs of SQL
COLS = COORDS
GROUPS = [f"g{i // 4}" for i in range(DIMS)]


def _fit(t: Tables):
    return mv.group_regression(_embedded(t), "mix", COLS, GROUPS, [0, 0.05, 0.2, 0.5])


def _optimal_groups(t: Tables):
    """Correlation of each column with the target, and whether its group meets the optimality condition of the group lasso."""
    m = mv.moments(_embedded(t), [*COLS, "mix"])
    gram, xy, l1, penalty = m.corr[:-1, :-1], m.corr[:-1, -1], 0.003, 0.05
    ids = np.array([int(g[1:]) for g in GROUPS])
    b = mv.group_lasso(gram, xy, ids, penalty, l1)
    rows = []
    for i, (c, g) in enumerate(zip(COLS, GROUPS)):
        at = ids == ids[i]
        pull = (xy - gram @ b)[at]
        cut, size = penalty / np.sqrt(at.sum()), np.linalg.norm(b[at])
        if size == 0:  # what is left of the gradient after the single penalties is no longer than the group's
            good = np.linalg.norm(np.sign(pull) * np.maximum(np.abs(pull) - l1, 0)) <= cut + 1e-6
        else:
            rest = pull - cut * b[at] / size
            good = bool(np.all(np.where(b[at] != 0, np.abs(rest - l1 * np.sign(b[at])) < 1e-6, np.abs(rest) <= l1 + 1e-6)))
        rows.append((c, g, round(float(xy[i]), 8), bool(good)))
    return t.spark.createDataFrame(rows, "variable string, grp string, corr double, optimal boolean")


R.add(
    "K9_optimal_groups",
    _optimal_groups,
    f"""with {LONG_SQL} select a.c as variable, 'g' || (substr(a.c, 2)::int // 4) as grp, round(corr(a.x, b.x), 8) as corr, true as optimal
from e a join e b on a.vec_id = b.vec_id and b.c = 'mix' where a.c not in ('mix', 'twin') group by 1, 2""",
)


def _optimal_classes(t: Tables):
    """Mean of each standardised column over the upper class, and whether the logistic group lasso is optimal there."""
    df = _embedded(t).withColumn("hit", F.when(F.col("mix") > 0, 1.0).otherwise(-1.0))
    m = mv.moments(df, [*COLS, "hit"])
    ids, l1, penalty = np.array([int(g[1:]) for g in GROUPS]), 0.003, 0.05
    (b,), _ = mv.logistic_group_lasso(df, COLS, "hit", m, ids, [penalty], l1)
    bias = 0.0
    for _ in range(50):  # the intercept is free
        s = mv.logistic_sums(df, COLS, "hit", m, b, bias)
        if abs(s["g"][0, -1]) < 1e-10:
            break
        bias -= s["g"][0, -1] / s["h"][-1, -1]
    pull, rows = -s["g"][0, :-1], []
    for i, c in enumerate(COLS):
        at = ids == ids[i]
        cut, size = penalty / np.sqrt(2 * at.sum()), np.linalg.norm(b[at])
        if size == 0:
            good = np.linalg.norm(np.sign(pull[at]) * np.maximum(np.abs(pull[at]) - l1, 0)) <= cut + 1e-5
        else:
            rest = pull[at] - cut * b[at] / size
            good = bool(np.all(np.where(b[at] != 0, np.abs(rest - l1 * np.sign(b[at])) < 1e-5, np.abs(rest) <= l1 + 1e-5)))
        share = m.mean[-1] / 2 + 0.5
        upper = m.corr[i, -1] * m.sd[-1] / (2 * share) if share else 0.0
        rows.append((c, round(float(upper), 7), bool(good)))
    return t.spark.createDataFrame(rows, "variable string, upper_mean double, optimal boolean")


R.add(
    "K9_optimal_classes",
    _optimal_classes,
    f"""with {LONG_SQL}, z as (select c, vec_id, (x - avg(x) over (partition by c)) / stddev_pop(x) over (partition by c) as z from e)
select z.c as variable, round(avg(z.z) filter (m.x > 0), 7) as upper_mean, true as optimal
from z join e m on z.vec_id = m.vec_id and m.c = 'mix' where z.c not in ('mix', 'twin') group by 1""",
)


def _group_order(t: Tables):
    fit = _fit(t)
    rows = [(g, i) for i, g in enumerate(fit.group_order)]
    return t.spark.createDataFrame(rows, "grp string, place int")


R.add("K9_group_order", _group_order)
R.add("K11_sankey_links", lambda t: mv.sankey_links(t.embeddings, _fit(t), "mix"))


def _ridge(t: Tables):
    fit = mv.group_regression(t.lineitem, "l_extendedprice", ["l_quantity"], ["g"])
    return rounded(mv.regression_stats(t.lineitem, "l_extendedprice", fit), "mae", "r2", "adjusted_r2", digits=6)


R.add(
    "K10_ridge_statistics",
    _ridge,
    """with m as (select count(*) n, corr(l_quantity, l_extendedprice) r, avg(l_quantity) mx, stddev_pop(l_quantity) sx, avg(l_extendedprice) my, stddev_pop(l_extendedprice) sy from lineitem),
c as (select *, n*r/(n+0.05) as b from m), d as (select *, 2*b*r-b*b as r2 from c)
select count(*) as n, round(avg(abs(l_extendedprice-(my+sy*b*(l_quantity-mx)/sx))),6) as mae, round(any_value(r2),6) as r2,
 round(any_value(1-(1-r2)*(n-1)/(n-2)),6) as adjusted_r2 from lineitem, d""",
)


def _classified(t: Tables):
    """Is the order expensive?  Predicted by a threshold on its priority digit."""
    y = (F.col("o_totalprice") > 250000).cast("int")
    score = F.substring("o_orderpriority", 1, 1).cast("double")
    return t.orders.select(y.alias("actual"), (score > 3).cast("int").alias("predicted"), (score / 6).alias("probability"))


R.add(
    "K10_classification_statistics",
    lambda t: rounded(mv.classification_stats(_classified(t), "actual", "predicted", "probability"), "accuracy", "precision", "recall", "roc_auc", "pr_auc"),
    """with c as (select (o_totalprice > 250000)::int as a, (substr(o_orderpriority,1,1)::double > 3)::int as p, substr(o_orderpriority,1,1)::double as s from orders),
b as (select sum(a*p) tp, sum((1-a)*p) fp, sum(a*(1-p)) fn, sum((1-a)*(1-p)) tn from c),
w as (select s, sum(sum(a)) over (order by s desc) as tp, sum(count(*)) over (order by s desc) as k from c group by s),
v as (select tp/k as pr, tp/(select sum(a) from c) as re, lag(tp/k, 1, 1.0) over (order by s desc) as pp, lag(tp/(select sum(a) from c), 1, 0.0) over (order by s desc) as rp from w)
select round((tp+tn)/(tp+fp+fn+tn),6) as accuracy, round(tp/(tp+fp),6) as precision, round(tp/(tp+fn),6) as recall, round((tp/(tp+fn)+tn/(tn+fp))/2,6) as roc_auc,
 (select round(sum((re-rp)*(pr+pp)/2),6) from v) as pr_auc from b""",
)


def _binary(t: Tables):
    df = _embedded(t).withColumn("hit", (F.col("mix") > 0).cast("double"))
    fit = mv.group_regression(df, "hit", COLS, GROUPS, [0, 0.05, 0.2, 0.5], binary=True)
    out = mv.fitted_values(df, fit, "decision", binary=True)
    return mv.confusion(out.withColumn("predicted", (F.col("decision") > 0).cast("int")), "hit", "predicted")


R.add("K9_K12_binary_groups", _binary)
R.add(
    "K12_confusion",
    lambda t: mv.confusion(t.lineitem, "l_returnflag", "l_linestatus"),
    "select l_returnflag as actual, l_linestatus as predicted, count(*) as n from lineitem group by 1, 2",
)
R.add("K13_seeded_sample", lambda t: mv.seeded_sample(t.orders, 300).select("o_orderkey"))


def _sample_facts(t: Tables):
    """Size, distinct rows, and rows that a second draw of the same seed shares, of orders and of their classes."""
    keys = [mv.seeded_sample(t.orders, 300).select("o_orderkey") for _ in range(2)]
    return keys[0].join(keys[1], "o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


R.add("K13_sample_facts", _sample_facts, "select least(count(*), 300) as n, least(count(*), 300) as keys from orders")
R.add(
    "K13_stratified_sample",
    lambda t: mv.stratified_sample(t.orders, "o_orderpriority", 300).groupBy("o_orderpriority").agg(F.count("*").alias("n")),
    """with c as (select o_orderpriority, count(*) as k, 300.0::double*count(*)/sum(count(*)) over () as e from orders group by 1),
f as (select *, floor(e)::bigint as take, row_number() over (order by floor(e) - e, o_orderpriority) as r from c)
select o_orderpriority, take + case when r <= 300 - (select sum(take) from f) then 1 else 0 end as n from f""",
)
R.add(
    "K14_encoded_labels",
    lambda t: derive.label_by_statistic(t.orders, "o_orderpriority", "o_totalprice").select("o_orderpriority", "code"),
    "select o_orderpriority, row_number() over (order by avg(o_totalprice)) - 1 as code from orders group by 1",
)
