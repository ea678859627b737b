"""Correlation, principal components, sparse graphical models and group-wise regression.

Rows are only ever aggregated: means, variances and covariances of p columns come from one pass, the p × p algebra
runs on the driver, and scores or fitted values are again column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numeric import is_finite
from millrace.operators import ordering
from millrace.operators.gram import complete_sums, pair_sums, summed, with_columns
from millrace.operators.lookup import look_up
from millrace.operators.quantiles import quantile_literals


@dataclass
class Moments:
    """Count, means, population deviations and correlations of some columns."""

    cols: list[str]
    n: int
    mean: np.ndarray
    sd: np.ndarray
    corr: np.ndarray

    def standardised(self, x: np.ndarray) -> np.ndarray:
        """Rows of values with zero mean and unit variance."""
        return (x - self.mean) / np.where(self.sd > 0, self.sd, 1.0)

    def standard(self, i: int) -> Column:
        """Column i with zero mean and unit variance (a constant column stays at zero)."""
        return (F.col(self.cols[i]).cast("double") - F.lit(float(self.mean[i]))) / F.lit(float(self.sd[i] or 1.0))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [is_finite(F.col(c).cast("double")) for c in cols]))


def moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Moments over complete rows."""
    cols = list(cols)
    n, mean, products = complete_sums(df, cols)
    sd = np.sqrt(np.maximum(np.diag(products), 0) / max(n, 1))
    scale = np.outer(sd, sd) * max(n, 1)
    corr = np.where(scale > 0, products / np.where(scale > 0, scale, 1), 0.0)
    np.fill_diagonal(corr, 1.0)
    return Moments(cols, n, mean, sd, corr)


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr, n) over the rows complete for each pair."""
    s = pair_sums(df, cols)
    n = np.maximum(s["n"], 1)
    spread = np.maximum(s["xx"] - s["x"] ** 2 / n, 0)
    both = s["xy"] - s["x"] * s["x"].T / n
    scale = np.sqrt(spread * spread.T)
    rows = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            corr = float(both[i, j] / scale[i, j]) if scale[i, j] > 1e-12 * max(s["xx"][i, j], s["xx"][j, i]) else None
            rows.append((a, cols[j], corr, int(s["n"][i, j])))
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double, n long")


def partial_from_precision(precision: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(precision))
    out = -precision / np.outer(scale, scale)
    np.fill_diagonal(out, 0.0)
    return out


def partial_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, pcorr) over complete rows, by the pseudo-inverse of the correlation matrix."""
    m = moments(df, cols)
    partial = partial_from_precision(np.linalg.pinv(m.corr))
    rows = [(a, b, float(partial[i, j])) for i, a in enumerate(m.cols) for j, b in enumerate(m.cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, pcorr double")


@dataclass
class Components:
    """A fitted principal component model."""

    moments: Moments
    rotation: np.ndarray
    sdev: np.ndarray
    explained: np.ndarray = field(init=False)

    def __post_init__(self):
        self.explained = self.sdev**2 / np.sum(self.sdev**2) * 100

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.explained)

    def components_for(self, percent: float = 80.0) -> int:
        """Number of components that explain ``percent``."""
        return int(np.argmax(self.cumulative >= percent - 1e-9)) + 1

    def scores(self, df: DataFrame, count: int | None = None) -> DataFrame:
        m, count = self.moments, count or len(self.moments.cols)
        turn = self.rotation[:, :count]
        return with_columns(df, m.cols, [f"pc{j + 1}" for j in range(count)], lambda x: m.standardised(x) @ turn)


def fit_components(df: DataFrame, cols: Sequence[str]) -> Components:
    """PCA of standardised columns.  Signs: the largest loading of each component is positive."""
    m = moments(df, cols)
    if any(s == 0 for s in m.sd):
        raise ValueError("zero variance: " + ", ".join(c for c, s in zip(m.cols, m.sd) if s == 0))
    values, vectors = np.linalg.eigh(m.corr * (m.n / max(m.n - 1, 1)))
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return Components(m, vectors * np.where(lead < 0, -1.0, 1.0), np.sqrt(values))


def explained_table(df: DataFrame, model: Components) -> DataFrame:
    rows = [(j + 1, float(s), float(e), float(c)) for j, (s, e, c) in enumerate(zip(model.sdev, model.explained, model.cumulative))]
    return df.sparkSession.createDataFrame(rows, "pc int, sdev double, explained double, cumulative double")


def t2_and_q(df: DataFrame, model: Components, count: int, sigma_from: DataFrame | None = None, contributions: bool = False) -> DataFrame:
    """Add T² and Q of each complete row (and the contribution of each column).

    The deviations of the scores are those of the given set itself, unless ``sigma_from`` names another set.
    """
    m, p = model.moments, len(model.moments.cols)
    df = df.drop(*[f"pc{j + 1}" for j in range(p)], "t2", "q")
    n, _, products = complete_sums(sigma_from if sigma_from is not None else df, m.cols)
    unit = np.where(m.sd > 0, m.sd, 1.0)
    spread = products / np.outer(unit, unit) / max(n, 1)
    sigma = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", model.rotation, spread, model.rotation), 0))
    sigma[sigma == 0] = 1.0
    names = [f"pc{j + 1}" for j in range(p)] + ["t2", "q"]
    names += [f"{c}__{k}" for c in m.cols for k in ("t2", "q")] if contributions else []

    def work(x: np.ndarray) -> np.ndarray:
        z = m.standardised(x)
        scores = z @ model.rotation
        rest = (z - scores[:, :count] @ model.rotation[:, :count].T) ** 2
        out = [scores, ((scores[:, :count] / sigma[:count]) ** 2).sum(axis=1, keepdims=True), rest.sum(axis=1, keepdims=True)]
        if contributions:
            parts = (scores / sigma) @ model.rotation.T
            with np.errstate(invalid="ignore", divide="ignore"):
                share = rest / out[2]
            out.append(np.stack([parts, share], axis=2).reshape(len(x), 2 * p))
        return np.column_stack(out)

    scored = with_columns(complete_rows(df, m.cols), m.cols, names, work)
    return scored.replace(float("nan"), None, [f"{c}__q" for c in m.cols]) if contributions else scored


def biplot(df: DataFrame, model: Components) -> tuple[dict[str, float], DataFrame]:
    """(circle radii, arrows): radii 1, 2, 3 sigma, largest and 85th percentile of the training scores."""
    scored = model.scores(complete_rows(df, model.moments.cols), 2)
    length = scored.select((F.col("pc1") ** 2 + F.col("pc2") ** 2).alias("r2"))
    most = length.agg(F.max("r2")).first()[0]
    share = quantile_literals(length, ["r2"], [0.85])["r2"][0]
    radii = {"sigma": 1.0, "2sigma": 2.0, "3sigma": 3.0, "max": most**0.5, "train": most**0.5, "percentile": share**0.5}
    loads = model.rotation * model.sdev
    direction = loads[:, :2] * (radii["max"] / np.sqrt(np.max(np.sum(loads**2, axis=1))))
    rows = [
        (c, float(x), float(y), float(np.degrees(np.arctan2(y, x)))) for c, (x, y) in zip(model.moments.cols, direction)
    ]
    return radii, df.sparkSession.createDataFrame(rows, "variable string, x double, y double, angle double")


# --- sparse graphical model -------------------------------------------------------------------------------------


def sparse_precision(cov: np.ndarray, alpha: float, rounds: int = 20_000, tol: float = 1e-8) -> np.ndarray:
    """Precision matrix minimising -logdet P + tr(cov P) + alpha · sum |off-diagonal of P|.

    Variables that no chain of covariances beyond ``alpha`` connects are independent in the solution, so each connected
    set is solved by itself, by alternating directions: an eigenvalue step for the likelihood, soft thresholds for the
    penalty.
    """
    p = len(cov)
    cov = cov + 1e-12 * np.eye(p)
    out, left = np.diag(1.0 / np.diag(cov)), set(range(p))
    near = np.abs(cov) > alpha
    while left:
        block, edge = set(), {min(left)}
        while edge:
            block |= edge
            edge = set(np.flatnonzero(near[sorted(edge)].any(axis=0)).tolist()) - block
        left -= block
        if len(block) > 1:
            at = sorted(block)
            out[np.ix_(at, at)] = _alternating(cov[np.ix_(at, at)], alpha, rounds, tol)
    return out


def _alternating(cov: np.ndarray, alpha: float, rounds: int, tol: float) -> np.ndarray:
    p, weight = len(cov), 1.0
    sparse, dual = np.diag(1.0 / np.diag(cov)), np.zeros((p, p))
    for _ in range(rounds):
        values, vectors = np.linalg.eigh(weight * (sparse - dual) - cov)
        smooth = (vectors * ((values + np.sqrt(values**2 + 4 * weight)) / (2 * weight))) @ vectors.T
        before, raw = sparse, smooth + dual
        sparse = np.sign(raw) * np.maximum(np.abs(raw) - alpha / weight, 0.0)
        np.fill_diagonal(sparse, np.diag(raw))
        dual = raw - sparse
        primal, change = np.linalg.norm(smooth - sparse), weight * np.linalg.norm(sparse - before)
        if max(primal, change) < tol * p:
            break
        if primal > 10 * change:
            weight, dual = 2 * weight, dual / 2
        elif change > 10 * primal:
            weight, dual = weight / 2, dual * 2
    return (sparse + sparse.T) / 2


def shrunk_correlation(m: Moments) -> np.ndarray:
    """Correlation matrix, shrunk towards its mean diagonal when its eigenvalues spread by more than one."""
    values = np.linalg.eigvalsh(m.corr)
    if values.max() - values.min() <= 1:
        return m.corr
    return 0.2 * m.corr + 0.8 * np.trace(m.corr) / len(m.corr) * np.eye(len(m.corr))


def extended_bic(precision: np.ndarray, cov: np.ndarray, n: int, gamma: float = 0.3) -> float:
    """-2 log-likelihood + E log n + 4 E gamma log p, with E the number of edges."""
    p = len(precision)
    edges = (np.count_nonzero(precision) - p) / 2
    likelihood = 0.5 * n * (np.linalg.slogdet(precision)[1] - np.sum(cov * precision))
    return float(-2 * likelihood + edges * np.log(n) + 4 * edges * gamma * np.log(p))


@dataclass
class SparseGraph:
    cols: list[str]
    alpha: float
    partial: np.ndarray
    path: list[tuple[float, float, int]]


def graphical_model(df: DataFrame, cols: Sequence[str], alphas: Sequence[float], target: str | None = None) -> SparseGraph:
    """Sparse partial correlations along ``alphas``.

    Without a target the smallest extended BIC wins; with one, the last alpha that leaves the target enough neighbours.
    """
    m = moments(df, cols)
    cov = shrunk_correlation(m)
    fits = []
    for alpha in alphas:
        precision = sparse_precision(cov, alpha)
        fits.append((alpha, partial_from_precision(precision), extended_bic(precision, cov, m.n)))
    path = [(a, bic, int(np.count_nonzero(np.triu(p, 1)))) for a, p, bic in fits]
    if target is None:
        best = min(fits, key=lambda f: f[2])
    else:
        at, enough = m.cols.index(target), min(10, np.ceil((len(m.cols) - 1) / 3))
        good = [f for f in fits if np.count_nonzero(f[1][at]) >= enough]
        best = good[-1] if good else fits[0]
    return SparseGraph(m.cols, best[0], best[1], path)


def tuned_graph(df: DataFrame, cols: Sequence[str], targets: Sequence[str], wanted: int | None = None) -> SparseGraph:
    """From strong to weak penalties until every target has ``wanted`` direct neighbours."""
    m = moments(df, cols)
    if wanted is None:
        wanted = int(min(len(cols) - len(targets), max(3, 1 + np.ceil(np.sqrt(len(targets))))))
    at, path = [m.cols.index(t) for t in targets], []
    for alpha in np.linspace(0.1, 1, 20)[::-1]:
        partial = partial_from_precision(sparse_precision(m.corr, float(alpha)))
        direct = min(np.count_nonzero(partial[i]) for i in at)
        path.append((float(alpha), float("nan"), int(np.count_nonzero(np.triu(partial, 1)))))
        if direct >= wanted:
            break
    return SparseGraph(m.cols, float(alpha), partial, path)


def graph_edges(df: DataFrame, graph: SparseGraph) -> DataFrame:
    rows = [
        (a, b, float(graph.partial[i, j]))
        for i, a in enumerate(graph.cols)
        for j, b in enumerate(graph.cols)
        if i < j and graph.partial[i, j] != 0
    ]
    return df.sparkSession.createDataFrame(rows, "source string, target string, weight double")


# --- group-wise regression --------------------------------------------------------------------------------------


@dataclass
class GroupFit:
    cols: list[str]
    groups: list[str]
    coef: np.ndarray
    group_order: list[str]
    r2: float
    n: int
    moments: Moments
    bic: list[float]


def group_lasso(gram: np.ndarray, xy: np.ndarray, groups: np.ndarray, penalty: float, l1: float = 0.003, rounds: int = 5000) -> np.ndarray:
    """Minimise ½ b'Gb - c'b + l1 |b| + penalty · sum over groups |b_g| / sqrt(size), by accelerated proximal steps."""
    step = 1.0 / max(np.linalg.eigvalsh(gram).max(), 1e-12)
    b = z = np.zeros(len(xy))
    t = 1.0
    for _ in range(rounds):
        raw = z - step * (gram @ z - xy)
        new = np.sign(raw) * np.maximum(np.abs(raw) - step * l1, 0.0)
        for g in np.unique(groups):
            at = groups == g
            size = np.linalg.norm(new[at])
            cut = step * penalty / np.sqrt(at.sum())
            new[at] = 0.0 if size <= cut else new[at] * (1 - cut / size)
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / following * (new - b)
        if np.max(np.abs(new - b), initial=0.0) < 1e-10:
            return new
        b, t = new, following
    return b


def logistic_sums(df: DataFrame, cols: Sequence[str], target: str, m: Moments, coef: np.ndarray, bias: float) -> dict[str, np.ndarray]:
    """Loss, gradient and curvature (intercept last) of the mean logistic loss, and wrong answers, over complete rows; target ±1."""

    def terms(x: np.ndarray) -> dict[str, np.ndarray]:
        x = x[np.isfinite(x).all(axis=1)]
        z, y = np.column_stack([(x[:, :-1] - m.mean[:-1]) / np.where(m.sd[:-1] > 0, m.sd[:-1], 1.0), np.ones(len(x))]), x[:, -1]
        score = z @ np.append(coef, bias)
        chance = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        loss = np.logaddexp(0, -y * score).sum()
        return {"n": np.array([[float(len(x))]]), "loss": np.array([[loss]]), "wrong": np.array([[float(((score > 0) != (y > 0)).sum())]]),
                "g": ((chance - (y > 0)) @ z)[None, :], "h": (z * (chance * (1 - chance))[:, None]).T @ z}

    found = summed(df, [*cols, target], terms)
    n = max(found["n"][0, 0], 1.0)
    return {k: v / n for k, v in found.items()}


def logistic_group_lasso(
    df: DataFrame, cols: Sequence[str], target: str, m: Moments, groups: np.ndarray, penalties: Sequence[float], l1: float = 0.003, rounds: int = 30, tol: float = 1e-7
) -> tuple[np.ndarray, list[float]]:
    """(coefficients, share of wrong answers) per penalty: mean logistic loss + l1 |b| + penalty · sum |b_g| / sqrt(2 size).

    Two opposite class vectors share the penalty of a group, hence the factor of sqrt(2).  Each step sums gradient and
    curvature over the rows once and solves the penalised quadratic on the driver; steps that raise the objective are
    halved.  Penalties are passed from the strongest to the weakest, each from the solution before it.
    """
    p = len(cols)
    out: dict[float, np.ndarray] = {}
    wrong: dict[float, float] = {}
    now = np.zeros(p + 1)

    def cost(b: np.ndarray, penalty: float) -> float:
        return l1 * np.abs(b[:p]).sum() + penalty * sum(np.linalg.norm(b[:p][groups == g]) / np.sqrt(2 * (groups == g).sum()) for g in np.unique(groups))

    for penalty in sorted(set(penalties), reverse=True):
        state = logistic_sums(df, cols, target, m, now[:p], now[p])
        for _ in range(rounds):
            value = state["loss"][0, 0] + cost(now, penalty)
            curve, slope = state["h"] + 1e-9 * np.eye(p + 1), state["g"][0]
            # the intercept has no penalty and is solved out
            gram = curve[:p, :p] - np.outer(curve[:p, p], curve[p, :p]) / curve[p, p]
            linear = (curve @ now - slope)[:p] - curve[:p, p] * (curve @ now - slope)[p] / curve[p, p]
            b = group_lasso(gram, linear, groups, penalty / np.sqrt(2), l1)
            goal = np.append(b, ((curve @ now - slope)[p] - curve[p, :p] @ b) / curve[p, p])
            share, moved = 1.0, goal - now
            while True:
                new = now + share * moved
                following = logistic_sums(df, cols, target, m, new[:p], new[p])
                if following["loss"][0, 0] + cost(new, penalty) <= value + 1e-12 or share < 1e-3:
                    break
                share /= 2
            now, state = new, following
            if np.abs(share * moved).max() < tol:
                break
        out[penalty], wrong[penalty] = now[:p].copy(), float(state["wrong"][0, 0])
    return np.array([out[x] for x in penalties]), [wrong[x] for x in penalties]


def vanishing_order(history: np.ndarray, groups: np.ndarray) -> list[int]:
    """Groups from important to unimportant: those that survive the strongest penalty first, the first to vanish last."""
    kinds = np.unique(groups)
    sums = np.array([[np.abs(row[groups == g]).sum() for g in kinds] for row in history])
    gone: list[int] = []
    previous = np.zeros(len(kinds))
    for row in sums:
        fresh = [g for g in range(len(kinds)) if row[g] == 0 and g not in gone]
        gone += sorted(fresh, key=lambda g: previous[g])
        previous = row
    left = sorted((g for g in range(len(kinds)) if g not in gone), key=lambda g: -sums[-1][g])
    return (gone + left)[::-1]


def group_regression(
    df: DataFrame,
    target: str,
    cols: Sequence[str],
    groups: Sequence[str],
    penalties: Sequence[float] = (0, 0.5, 1.0, 5.0),
    ridge: float = 0.05,
    binary: bool = False,
) -> GroupFit:
    """Importance of column groups (group lasso, best BIC) and ridge coefficients of the columns kept.

    Only the moments of the data are needed for a number.  For a two-class target the groups are chosen by a logistic
    group lasso; the columns kept are then fitted to ±1 by ridge regression, as a ridge classifier does.
    """
    cols = list(cols)
    if binary:
        lo, hi = df.agg(F.min(target), F.max(target)).first()
        df = df.withColumn(target, F.when(F.col(target) == F.lit(hi), 1.0).when(F.col(target) == F.lit(lo), -1.0))
    m = moments(df, [*cols, target])
    gram, xy = m.corr[:-1, :-1], m.corr[:-1, -1]
    names = list(dict.fromkeys(groups))
    ids = np.array([names.index(g) for g in groups])
    keep, order, bics = np.arange(len(cols)), list(range(len(names))), []
    if len(names) > 1:
        if binary:
            history, wrong = logistic_group_lasso(df, cols, target, m, ids, penalties)
            # each column has a coefficient for either class
            bics = [float(m.n * w + np.log(m.n) * 2 * np.count_nonzero(b)) for b, w in zip(history, wrong)]
        else:
            history = np.array([group_lasso(gram, xy, ids, p) for p in penalties])
            for b in history:
                mse = 1.0 - 2 * b @ xy + b @ gram @ b
                bics.append(float(m.n * mse + np.log(m.n) * np.count_nonzero(b)))
        order = vanishing_order(history, ids)
        chosen = np.flatnonzero(history[int(np.argmin(bics))])
        keep = chosen if len(chosen) else keep
    coef = np.zeros(len(cols))
    # Standardised columns; a ±1 target keeps its own scale, as a ridge classifier does.
    scale = m.sd[-1] if binary else 1.0
    coef[keep] = np.linalg.solve(m.n * gram[np.ix_(keep, keep)] + ridge * np.eye(len(keep)), m.n * xy[keep]) * scale
    unit = coef / scale
    r2 = float(2 * unit @ xy - unit @ gram @ unit)
    return GroupFit(cols, list(groups), coef, [names[i] for i in order], r2, m.n, m, bics)


def fitted_values(df: DataFrame, fit: GroupFit, out: str = "fitted", binary: bool = False) -> DataFrame:
    """Fitted target (its own unit), or with ``binary`` the decision value and probability of the upper class."""
    m = fit.moments
    unit = np.where(m.sd[:-1] > 0, m.sd[:-1], 1.0)
    rows = with_columns(complete_rows(df, fit.cols), fit.cols, ["_linear"], lambda x: ((x - m.mean[:-1]) / unit @ fit.coef)[:, None])
    rows, linear = rows.withColumnRenamed("_linear", out), F.col(out)
    if binary:
        decision = linear + F.lit(float(m.mean[-1]))
        return rows.withColumns({out: decision, "probability": 1 / (1 + F.exp(-decision))})
    return rows.withColumn(out, linear * F.lit(float(m.sd[-1])) + F.lit(float(m.mean[-1])))


def regression_stats(df: DataFrame, target: str, fit: GroupFit) -> DataFrame:
    """(n, mae, r2, adjusted_r2)."""
    used = int(np.count_nonzero(fit.coef))
    adjusted = 1 - (1 - fit.r2) * (fit.n - 1) / (fit.n - used - 1)
    error = F.abs(F.col(target).cast("double") - F.col("fitted"))
    rows = complete_rows(fitted_values(df, fit), [target])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae")).withColumns(
        {"r2": F.lit(fit.r2), "adjusted_r2": F.lit(float(adjusted))}
    )


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_stats(df: DataFrame, actual: str, predicted: str, probability: str) -> DataFrame:
    """(accuracy, precision, recall, roc_auc, pr_auc) of 0/1 columns; roc_auc is that of the predicted classes."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    base = df.agg(
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & ~p).alias("tn"),
    ).first()
    tp, fp, fn, tn = (base[k] for k in ("tp", "fp", "fn", "tn"))
    by_score = df.groupBy(F.col(probability).alias("s")).agg(
        F.count_if(a).cast("long").alias("hit"), F.count("*").alias("all")
    )
    walked = ordering.running_sum(by_score, "hit", [("s", "desc")], out="tp")
    walked = ordering.running_sum(walked, "all", [("s", "desc")], out="seen")
    walked = walked.withColumn("point", F.struct((F.col("tp") / F.col("seen")).alias("p"), F.try_divide(F.col("tp"), F.lit(tp + fn)).alias("r")))
    walked = ordering.shift(walked, "point", 1, [("s", "desc")], out="before")
    p0, r0 = F.coalesce("before.p", F.lit(1.0)), F.coalesce("before.r", F.lit(0.0))
    area = walked.agg(F.sum((F.col("point.r") - r0) * (F.col("point.p") + p0) / 2)).first()[0]
    total = tp + fp + fn + tn
    stats = {
        "accuracy": (tp + tn) / total if total else None,
        "precision": tp / (tp + fp) if tp + fp else 0.0,
        "recall": tp / (tp + fn) if tp + fn else 0.0,
        "roc_auc": (tp / (tp + fn) + tn / (tn + fp)) / 2 if (tp + fn) and (tn + fp) else None,
        "pr_auc": area,
    }
    schema = ", ".join(f"{k} double" for k in stats)
    return df.sparkSession.createDataFrame([tuple(stats.values())], schema)


def sankey_links(df: DataFrame, fit: GroupFit, target: str, most: int | None = None) -> DataFrame:
    """(source, target, value, sign) from columns to groups to the target; ``most`` keeps the largest coefficients."""
    top = sorted(range(len(fit.cols)), key=lambda i: -abs(fit.coef[i]))[:most]
    used = [i for i in sorted(top) if fit.coef[i]]
    rows = [(fit.cols[i], fit.groups[i], abs(float(fit.coef[i])), int(np.sign(fit.coef[i]))) for i in used]
    for g in dict.fromkeys(fit.groups[i] for i in used):
        rows.append((g, target, float(sum(abs(fit.coef[i]) for i in used if fit.groups[i] == g)), 0))
    return df.sparkSession.createDataFrame(rows, "source string, target string, value double, sign int")


def seeded_sample(df: DataFrame, rows: int, seed: int = 1) -> DataFrame:
    """A seeded sample of exactly ``rows`` rows (all, if fewer): an option of its own, the models above use all rows.

    Rows are taken in the order of a keyed hash of all their values, a bounded top list per task.
    """
    return _by_hash(df, seed).limit(rows)


def _by_hash(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), *df.columns)


def stratified_sample(df: DataFrame, by: str, rows: int, seed: int = 1) -> DataFrame:
    """A seeded sample of ``rows`` rows in which every value of ``by`` keeps its share.

    Shares are rounded down and the rows left over go to the largest remainders (ties by value); a value's rows are
    the first in the order of a keyed hash.
    """
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    if total <= rows:
        return df
    exact = {v: rows * n / total for v, n in counts.items()}
    take = {v: int(e) for v, e in exact.items()}
    left = sorted(exact, key=lambda v: (take[v] - exact[v], v is None, str(v)))
    for v in left[: rows - sum(take.values())]:
        take[v] += 1
    kind = T.StructType([T.StructField("_stratum", df.schema[by].dataType), T.StructField("_take", T.LongType())])
    wanted = df.sparkSession.createDataFrame([(v, n) for v, n in take.items()], kind)
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]))
    numbered = ordering.row_numbers(hashed, ["_hash", *df.columns], [by], "_rn")
    kept = look_up(numbered, wanted, [(F.col(by), "_stratum")], null_safe=True, keep=lambda table: table)
    return kept.where(F.col("_rn") <= F.col("_take")).select(*df.columns)
