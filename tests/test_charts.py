from datetime import datetime

import pytest

from millrace.plans.charts import CHARTS, chart


def test_chart_calls(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = chart("aggregate", events, col="value", function="count", facets=["event_type"]).collect()
    assert sum(r["agg"] for r in rows) == events.count()
    assert chart("stratified", events, cols=["value"], by=["event_type"]).count() == len(rows)


def test_chart_errors(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="unknown chart"):
        chart("pie", df)
    with pytest.raises(ValueError, match="missing"):
        chart("heatmap", df, x="id")
    assert len(CHARTS) == 17


EVENTS = {
    "full_points": {"cols": ["value"], "time": "ts", "slots": 50},
    "summary": {"x": "ts", "y": "value", "keys": ["event_type"]},
    "stratified": {"cols": ["value"], "by": ["event_type"]},
    "ridgeline": {"col": "value", "keys": ["event_type"], "points": 16},
    "emd": {"col": "value", "group": "event_type"},
    "calendar_heatmap": {"time": "ts", "col": "value", "function": "mean", "start": datetime(2024, 1, 1), "end": datetime(2024, 2, 1), "step_minutes": 30},
    "heatmap": {"x": "event_type", "y": "user_id", "color": "value", "function": "mean"},
    "scatter": {"axes": ["value", "user_id"], "color": "event_type"},
    "scatter_matrix": {"x": "value", "y": "user_id", "bins": 10},
    "correlations": {"cols": ["value", "user_id", "event_id"]},
    "parallel": {"cols": ["value"], "categories": ["event_type"]},
    "co_occurrence": {"time": "ts", "cols": ["user_id", "event_id"]},
    "pareto": {"cols": ["user_id", "event_id"]},
    "sankey": {"target": "value", "cols": ["user_id", "event_id"], "groups": ["a", "b"]},
    "graphical_lasso": {"cols": ["value", "user_id", "event_id"], "alphas": [0.05, 0.3]},
}


@pytest.mark.parametrize("kind", sorted(EVENTS))
def test_every_chart(spark, sf, kind):
    events = spark.read.parquet(f"{sf}/events.parquet").where("value is not null")
    out = chart(kind, events, **EVENTS[kind])
    rows = out.collect()
    assert rows or kind in ("sankey", "graphical_lasso")
    if kind == "calendar_heatmap":
        assert len(rows) == 31 * 48


def test_components_chart(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").where("value is not null")
    out = chart("pca", events, test=events, cols=["value", "user_id", "event_id"])
    assert out.count() == events.count() and {"t2", "q"} <= set(out.columns)
    assert set(EVENTS) | {"pca", "aggregate"} == set(CHARTS)
