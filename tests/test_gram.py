"""Sums over many columns against numpy; sparse graphs at width."""

import time

import numpy as np
import pytest

from millrace.operators import gram
from millrace.operators import multivariate as mv


@pytest.fixture(scope="module")
def wide(spark):
    """300 columns, some missing and infinite values, a constant column."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 300)) @ (np.eye(300) + 0.2 * rng.normal(size=(300, 300)) / 17) + rng.normal(size=300) * 1000
    x[:, 7] = 3.0
    holes = x.copy()
    holes[rng.random(x.shape) < 0.05] = np.nan
    holes[3, 5], holes[4, 6] = np.inf, -np.inf
    cols = [f"c{i}" for i in range(300)]
    make = lambda a: spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in a], cols).repartition(5)
    return cols, x, holes, make(x), make(holes)


def test_moments_of_300_columns(wide):
    cols, x, _, df, _ = wide
    m = mv.moments(df, cols)
    assert m.n == 400 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.sd, x.std(axis=0), atol=1e-9)
    live = np.arange(300) != 7
    assert np.allclose(m.corr[np.ix_(live, live)], np.corrcoef(x[:, live].T), atol=1e-10)


def test_pairs_with_missing_values(wide):
    cols, _, x, _, df = wide
    found = {(r.a, r.b): (r["corr"], r.n) for r in mv.pair_correlations(df, cols).collect()}
    assert len(found) == 300 * 299 // 2
    for i, j in [(0, 1), (5, 6), (3, 299), (130, 131), (7, 8)]:
        known = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        corr, n = found[f"c{i}", f"c{j}"]
        assert n == known.sum()
        assert corr is None if 7 in (i, j) else corr == pytest.approx(np.corrcoef(x[known, i], x[known, j])[0, 1], abs=1e-10)


def test_scores_of_300_columns(wide, spark):
    cols, x, _, df, _ = wide
    live = [c for c in cols if c != "c7"]
    model = mv.fit_components(df, live)
    out = mv.t2_and_q(df, model, 20).select("c0", "t2", "q").toPandas().sort_values("c0")
    z = np.delete(x, 7, axis=1)
    z = ((z - z.mean(axis=0)) / z.std(axis=0))[np.argsort(x[:, 0])]
    scores = z @ model.rotation
    assert np.allclose(out["t2"], ((scores[:, :20] / scores.std(axis=0)[:20]) ** 2).sum(axis=1))
    assert np.allclose(out["q"], ((z - scores[:, :20] @ model.rotation[:, :20].T) ** 2).sum(axis=1))


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert gram.complete_sums(df, ["a", "b"])[0] == 0
    assert mv.pair_correlations(df, ["a", "b"]).collect()[0].n == 0


@pytest.mark.parametrize("p, alpha", [(40, 0.1), (300, 0.25)])
def test_sparse_precision_is_optimal(p, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2 * p, p)) @ (np.eye(p) + 0.3 * np.diag(np.ones(p - 1), 1))
    cov = np.corrcoef(x.T)
    start = time.time()
    precision = mv.sparse_precision(cov, alpha)
    assert time.time() - start < 60
    slope = np.linalg.inv(precision) - cov
    off = ~np.eye(p, dtype=bool)
    edge = (precision != 0) & off
    assert edge.any() and np.abs(slope[edge] - alpha * np.sign(precision[edge])).max() < 1e-4
    assert np.abs(slope[off & ~edge]).max() <= alpha + 1e-4 and np.abs(np.diag(slope)).max() < 1e-4
