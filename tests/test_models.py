"""Densities and multivariate models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate, autolink, density, multivariate as mv, series


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x[:, 1] += 0.8 * x[:, 0]
    x[:, 3] -= 0.5 * x[:, 2]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    return x, df.cache()


def test_pca(spark, cloud):
    x, df = cloud
    model = mv.fit_components(df, ["a", "b", "c", "d"])
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert np.allclose(model.sdev**2, values)
    k = model.components_for(80)
    assert np.cumsum(values)[k - 1] / values.sum() >= 0.8 > (np.cumsum(values)[k - 2] / values.sum() if k > 1 else 0)
    out = mv.t2_and_q(df, model, k, contributions=True).orderBy("id").toPandas()
    scores = z @ model.rotation
    t2 = (scores[:, :k] ** 2 / scores.std(0)[:k] ** 2).sum(1)
    rest = z - z @ model.rotation[:, :k] @ model.rotation[:, :k].T
    assert np.allclose(out["t2"], t2) and np.allclose(out["q"], (rest**2).sum(1))
    assert np.allclose(out[[f"{c}__q" for c in "abcd"]].sum(axis=1), 1)


def test_sparse_precision_is_optimal(cloud):
    x, _ = cloud
    cov, alpha = np.corrcoef(x.T), 0.1
    p = mv.sparse_precision(cov, alpha)
    gradient = cov - np.linalg.inv(p)
    off = ~np.eye(4, dtype=bool)
    assert np.allclose(np.diag(gradient), 0, atol=1e-5)
    assert np.all(np.abs(gradient[off]) <= alpha + 1e-5)
    live = off & (p != 0)
    assert np.allclose(gradient[live], -alpha * np.sign(p[live]), atol=1e-4)
    assert p[0, 1] != 0 and p[0, 3] == 0


def test_graph_choices(spark, cloud):
    _, df = cloud
    graph = mv.tuned_graph(df, ["a", "b", "c", "d"], ["a"], 1)
    edges = {(r["source"], r["target"]) for r in mv.graph_edges(df, graph).collect()}
    assert ("a", "b") in edges
    assert len(mv.graphical_model(df, ["a", "b", "c", "d"], [0.05, 0.1]).path) == 2


def test_group_lasso_is_optimal(cloud):
    x, _ = cloud
    z = (x - x.mean(0)) / x.std(0)
    gram, xy = z[:, :3].T @ z[:, :3] / len(z), z[:, :3].T @ z[:, 3] / len(z)
    groups = np.array([0, 0, 1])
    b = mv.group_lasso(gram, xy, groups, 0.1, l1=0.0)
    slope = gram @ b - xy
    for g in (0, 1):
        at = groups == g
        weight = 0.1 / np.sqrt(at.sum())
        if np.any(b[at]):
            assert np.allclose(slope[at], -weight * b[at] / np.linalg.norm(b[at]), atol=1e-6)
        else:
            assert np.linalg.norm(slope[at]) <= weight + 1e-8
    assert np.any(b[2:]) and not np.any(b[:2])


def test_group_regression(spark, cloud):
    _, df = cloud
    fit = mv.group_regression(df, "d", ["a", "b", "c"], ["ab", "ab", "c"], [0, 0.05, 0.1])
    assert fit.group_order[0] == "c"
    fitted = mv.fitted_values(df, fit)
    r = fitted.agg(F.corr("fitted", "d")).first()[0]
    assert abs(r * r - fit.r2) < 0.01


def test_density_2d(spark, cloud):
    x, df = cloud
    grid, ranges = density.density_2d(df, "a", "b", 10)
    pts = x[:, :2]
    cov = np.cov(pts.T) * len(pts) ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 1 / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * len(pts))
    gx, gy = (np.linspace(*ranges[c], 11) for c in ("x", "y"))
    want = [[norm * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d := np.array([u, v]) - pts, inv, d)).sum() for v in gy] for u in gx]
    assert np.allclose(grid, want)


def test_sparse_points(spark, cloud):
    _, df = cloud
    out = density.sparse_points(df, "a", "b", 10)
    assert out.count() == 300
    assert 15 <= out.where("low_density").count() < 60


def test_ridgeline_has_unit_peak(spark, cloud):
    _, df = cloud
    out = density.ridgeline(df.withColumn("g", F.col("id") % 2), "a", ["g"])
    assert {round(r["s"], 9) for r in out.groupBy("g").agg(F.max("share").alias("s")).collect()} == {1.0}


def test_emd(spark, cloud, buckets):
    _, df = cloud
    shifted = df.select(F.lit("1").alias("g"), "a").unionByName(df.select(F.lit("2").alias("g"), (F.col("a") + 1).alias("a")))
    got = {r["g"]: r["emd"] for r in density.emd(shifted, "a", "g").collect()}
    assert got["1"] == 0 and abs(got["2"] - 1) < 0.1
    constant = spark.createDataFrame([("1", 5.0), ("2", 5.0)], "g string, a double")
    assert [r["emd"] for r in density.emd(constant, "a", "g").collect()] == [0, 0]


def test_thin_keeps_extremes(spark, cloud, buckets):
    x, df = cloud
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    out = series.thin(timed, ["a"], "ts", slots=20)
    low, high, n = out.agg(F.min("a_min"), F.max("a_max"), F.sum("n")).first()
    assert (low, high, n) == (x[:, 0].min(), x[:, 0].max(), 300)


def test_thin_slot_of_infinities(spark):
    df = spark.createDataFrame([(0, float("inf")), (1, float("inf")), (100, 1.0)], "s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    out = series.thin(df, ["v"], "ts", slots=2).orderBy("slot").collect()
    assert [(r["v_min"], r["v_median"], r["v_max"]) for r in out] == [(float("inf"),) * 3, (1.0,) * 3]


def test_chains(spark):
    rows = [("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("b", 2, 2), ("c", 9, 3), ("d", 2, 4)]
    df = spark.createDataFrame(rows, "process string, serial long, date long")
    assert autolink.chains(df, ["a", "b", "c", "d"]) == [["a", "b", "d"], ["c"]]


def test_pareto(spark):
    df = spark.createDataFrame([(8, 1, 1)], "a long, b long, c long")
    rows = aggregate.pareto(df, ["a", "b", "c"]).orderBy(F.desc("total"), "name").collect()
    assert [(r["name"], r["ratio"], r["highlight"]) for r in rows] == [("a", 0.8, True), ("b", 0.9, False), ("c", 1.0, False)]


def test_classification(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)]
    got = mv.classification_stats(spark.createDataFrame(rows, "y int, p int, s double"), "y", "p", "s").first()
    assert (got["accuracy"], got["precision"], got["recall"], got["roc_auc"]) == (0.5, 0.5, 0.5, 0.5)
    assert abs(got["pr_auc"] - (0.5 * 1 + 0 + 0.5 * (0.5 + 2 / 3) / 2)) < 1e-9
