"""Joins with a key on half of the rows, on the left, on the right, on both sides, against pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import links
from millrace.operators.hotkeys import hot_keys, spread_join
from millrace.spec import LinkKey


def frames(seed, hot_left, hot_right):
    rng = np.random.default_rng(seed)
    keys = lambda n, hot: [None if i % 17 == 0 else "hot" if hot and i % 2 else f"k{rng.integers(0, 400)}" for i in range(n)]
    left = pd.DataFrame({"a": range(900), "ka": keys(900, hot_left)})
    right = pd.DataFrame({"b": range(700), "kb": keys(700, hot_right)})
    if not hot_right:
        right.loc[3, "kb"] = "hot"
    return left, right


@pytest.mark.parametrize("hot_left, hot_right", [(True, False), (False, True), (True, True), (False, False)])
@pytest.mark.parametrize("inner", [True, False])
def test_joins(spark, hot_left, hot_right, inner):
    left, right = frames(1, hot_left, hot_right)
    l, r = spark.createDataFrame(left, "a long, ka string"), spark.createDataFrame(right, "b long, kb string")
    got = sorted(((x["a"], x["b"]) for x in spread_join(l, r, ["ka"], ["kb"], inner).collect()), key=str)
    known = right.dropna()
    want = left.dropna().merge(known, left_on="ka", right_on="kb")[["a", "b"]].astype(object)
    pairs = [tuple(map(int, p)) for p in want.values]
    if not inner:
        pairs += [(a, None) for a in left["a"] if a not in {p[0] for p in pairs}]
    assert got == sorted(pairs, key=str)
    assert (hot_keys(l, ["ka"]) is not None) == hot_left


def test_no_task_has_more_than_its_share(spark):
    """The rows of the join by the partition they were dealt to."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("false", "-1", "64")):
        spark.conf.set(k, v)
    try:
        n = 64_000
        l = spark.range(n).select(F.col("id").alias("a"), F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("ka"))
        r = spark.range(n).select(F.col("id").alias("b"), F.when(F.col("id") == 0, F.lit(-1)).otherwise(F.col("id")).alias("kb"))
        out = links.equi_link(l, r, [LinkKey("ka", "kb")])
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < 8 * n / 64


def test_time_link_with_a_hot_time(spark):
    t0 = datetime(2024, 1, 1)
    left = [(i, 1, t0 + timedelta(minutes=i % 3)) for i in range(300)]
    right = [(100 + i, 1, t0 + timedelta(minutes=10)) for i in range(4)]
    l, r = spark.createDataFrame(left, "a long, ka long, ta timestamp"), spark.createDataFrame(right, "b long, kb long, tb timestamp")
    got = links.time_link(l, r, "ta", "tb", 9, 5, [LinkKey("ka", "kb")]).groupBy("a").count().collect()
    assert len(got) == 300 and all(x["count"] == 4 for x in got)
