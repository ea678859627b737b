"""One entry point for the tables behind each chart: ``chart("heatmap", df, x=..., y=..., ...)``."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.operators import aggregate, density, derive, multivariate, series, summary


def _pca(df: DataFrame, test: DataFrame, cols: list[str], percent: float = 80.0) -> DataFrame:
    model = multivariate.fit_components(df, cols)
    return multivariate.t2_and_q(test, model, model.components_for(percent), contributions=True)


def _sankey(df: DataFrame, target: str, cols: list[str], groups: list[str], binary: bool = False) -> DataFrame:
    fit = multivariate.group_regression(df, target, cols, groups, binary=binary)
    return multivariate.sankey_links(df, fit, target)


def _graph(df: DataFrame, cols: list[str], alphas: list[float], target: str | None = None) -> DataFrame:
    return multivariate.graph_edges(df, multivariate.graphical_model(df, cols, alphas, target))


def _stratified(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    return summary.basic_stats(df.dropna(subset=by), cols, by)


def _parallel(df: DataFrame, cols: list[str], categories: list[str]) -> DataFrame:
    for c in categories:
        df = derive.category_codes(df, c)
    return df.select(*cols, *[f"{c}_code" for c in categories])


CHARTS: dict[str, Callable[..., DataFrame]] = {
    "full_points": series.thin,
    "summary": summary.full_summary,
    "stratified": _stratified,
    "ridgeline": density.ridgeline,
    "emd": density.emd,
    "calendar_heatmap": aggregate.calendar_heatmap,
    "heatmap": aggregate.xy_heatmap,
    "scatter": series.plot_rows,
    "scatter_matrix": density.contour,
    "correlations": multivariate.pair_correlations,
    "parallel": _parallel,
    "aggregate": aggregate.aggregate_plot,
    "pca": _pca,
    "sankey": _sankey,
    "graphical_lasso": _graph,
    "co_occurrence": aggregate.co_occurrence,
    "pareto": aggregate.pareto,
}


def chart(kind: str, df: DataFrame, **options) -> DataFrame:
    """Checked call of a chart's operator; an unknown chart, a missing or an unknown option is a ValueError."""
    if kind not in CHARTS:
        raise ValueError(f"unknown chart {kind!r}; known: {', '.join(sorted(CHARTS))}")
    try:
        inspect.signature(CHARTS[kind]).bind(df, **options)
    except TypeError as error:
        raise ValueError(f"{kind}: {error}") from error
    return CHARTS[kind](df, **options)
