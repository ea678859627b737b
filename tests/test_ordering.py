"""Order-dependent operators and quantiles against pandas, in one bucket and split over many."""

import numpy as np
import pandas as pd
import pytest

from millrace.operators import ordering
from millrace.operators.quantiles import modes, quantiles
from millrace.operators.series import resample


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 120
    return pd.DataFrame(
        {
            "id": range(n),
            # One key holds most rows, and one time many copies.
            "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)),
            "t": np.where(rng.random(n) < 0.4, 50, rng.integers(0, 100, n)),
            "v": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n).round(3)),
        }
    )


def to_spark(spark, pdf):
    rows = [(int(r.id), r.k, int(r.t), None if pd.isna(r.v) else float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "id long, k string, t long, v double")


def collect(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def test_row_numbers(spark, frame, buckets):
    df = to_spark(spark, frame)
    got = collect(ordering.row_numbers(df, ["t", "id"], ["k"]), "rn")
    want = frame.sort_values(["t", "id"]).groupby("k").cumcount() + 1
    assert got == {frame.id[i]: v for i, v in want.items()}
    got = collect(ordering.row_numbers(df, [("t", "desc"), "id"]), "rn")
    want = frame.sort_values(["t", "id"], ascending=[False, True]).id.tolist()
    assert got == {i: n + 1 for n, i in enumerate(want)}


def test_running_sum(spark, frame, buckets):
    df = to_spark(spark, frame).fillna(0, ["v"])
    got = collect(ordering.running_sum(df, "t", ["t", "id"], ["k"]), "running")
    want = frame.sort_values(["t", "id"]).groupby("k").t.cumsum()
    assert got == {frame.id[i]: v for i, v in want.items()}


@pytest.mark.parametrize("forward", [True, False])
def test_fill(spark, frame, buckets, forward):
    got = collect(ordering.fill(to_spark(spark, frame), "v", ["t", "id"], ["k"], forward), "v")
    ordered = frame.sort_values(["t", "id"]).groupby("k").v
    want = ordered.ffill() if forward else ordered.bfill()
    for i, v in want.items():
        assert got[frame.id[i]] == (None if pd.isna(v) else v)


@pytest.mark.parametrize("offset", [1, -1, 3, -2, 0])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_shift(spark, frame, buckets, offset, keys):
    got = collect(ordering.shift(to_spark(spark, frame), "t", offset, ["t", "id"], keys, -7, "s"), "s")
    ordered = frame.sort_values(["t", "id"])
    want = (ordered.groupby("k") if keys else ordered).t.shift(offset, fill_value=-7)
    assert got == {frame.id[i]: v for i, v in want.items()}


def test_first_rows(spark, frame, buckets):
    df = ordering.first_rows(to_spark(spark, frame), ["k"], [("t", "desc"), "id"], 2)
    want = frame.sort_values(["t", "id"], ascending=[False, True]).groupby("k").head(2)
    assert {r["id"] for r in df.collect()} == set(want.id)


@pytest.mark.parametrize("method", ["linear", "midpoint"])
def test_quantiles(spark, frame, buckets, method):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    rows = quantiles(to_spark(spark, frame), ["v", "t"], probs, ["k"], method, names).collect()
    assert len(rows) == 8
    for r in rows:
        values = frame[frame.k == r["k"]][r["variable"]].dropna()
        want = np.quantile(values, probs, method=method)
        assert np.allclose([r[n] for n in names], want)


def test_modes(spark, frame):
    got = {r["k"]: r["mode"] for r in modes(to_spark(spark, frame), "t", ["k"]).collect()}
    assert got == {k: g.t.mode()[0] for k, g in frame.groupby("k")}


def test_resample_keeps_shape(spark, buckets):
    values = np.random.default_rng(1).normal(size=101)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = sorted(r[0] for r in resample(df, "v", 21).collect())
    assert len(out) == 21
    assert out[0] == values.min() and out[-1] == values.max() and out[10] == np.median(values)


def test_descending_text_is_refused(spark, frame):
    with pytest.raises(ValueError):
        ordering.row_numbers(to_spark(spark, frame), [("k", "desc")])
