"""Streams against the batch operators on the same rows."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from millrace.operators.links import time_link
from millrace.plans.importer import ImportSpec
from millrace.sources import store
from millrace.spec import LinkKey
from millrace.streaming import flows

T0 = datetime(2024, 1, 1)
HOW = {"left_time": "ta", "delta_minutes": 600, "cut_off_minutes": 480, "keys": [LinkKey("ka", "kb")]}
LEFT, RIGHT = "a long, ka long, ta timestamp", "b long, kb long, tb timestamp"


def batch(spark, starts, targets):
    """A micro-batch as ``link_streams`` makes it."""
    l, r = spark.createDataFrame(starts, LEFT), spark.createDataFrame(targets, RIGHT)
    left = l.select(F.struct("*").alias("start"), F.lit(None).cast(f"struct<{RIGHT.replace(' long', ':long').replace(' timestamp', ':timestamp')}>").alias("target"))
    right = r.select(F.lit(None).cast(f"struct<{LEFT.replace(' long', ':long').replace(' timestamp', ':timestamp')}>").alias("start"), F.struct("*").alias("target"))
    return left.union(right)


def links(spark, path):
    return sorted(((r["a"], r["b"]) for r in spark.read.parquet(f"{path}/links").collect()), key=str)


def test_target_ten_hours_late(spark, tmp_path):
    path = str(tmp_path)
    start = [(1, 7, T0), (2, 7, T0 + timedelta(hours=30)), (3, None, T0), (4, 7, None)]
    flows.link_micro_batch(batch(spark, start, []), 0, path, "tb", timedelta(0), **HOW)
    assert links(spark, path) == [(4, None)]  # nothing can be said of the others yet
    flows.link_micro_batch(batch(spark, [], [(10, 7, T0 + timedelta(hours=10))]), 1, path, "tb", timedelta(0), **HOW)
    flows.link_micro_batch(batch(spark, [], [(11, 7, T0 + timedelta(hours=9)), (12, 7, T0 + timedelta(hours=20))]), 2, path, "tb", timedelta(0), **HOW)
    assert links(spark, path) == [(1, 10), (3, None), (4, None)]
    flows.close_links(spark, path, "tb", **HOW)
    assert links(spark, path) == [(1, 10), (2, None), (3, None), (4, None)]


def test_any_arrival_equals_one_join(spark, tmp_path):
    """Records in random batches; every batch is run twice, as after a failure."""
    path, rng = str(tmp_path), np.random.default_rng(3)
    minutes = lambda: timedelta(minutes=int(rng.integers(0, 6000)))
    starts = [(i, int(rng.integers(0, 3)) if i % 9 else None, T0 + minutes()) for i in range(60)]
    targets = [(100 + i, int(rng.integers(0, 3)), T0 + minutes()) for i in range(60)]
    for number in range(4):
        # targets come in the order of their time, but for half a day
        come = [t for t in targets if int((t[2] - T0 + timedelta(minutes=int(t[0] * 37 % 720))).total_seconds() // 60 // 1700) == number]
        part = batch(spark, starts[number::4], come)
        for _ in range(2):
            flows.link_micro_batch(part, number, path, "tb", timedelta(hours=12), **HOW)
    flows.close_links(spark, path, "tb", **HOW)
    want = time_link(spark.createDataFrame(starts, LEFT), spark.createDataFrame(targets, RIGHT), right_time="tb", **HOW)
    assert links(spark, path) == sorted(((r["a"], r["b"]) for r in want.collect()), key=str)


def test_grown_columns_are_not_duplicates(spark, tmp_path):
    path, spec = str(tmp_path), ImportSpec("at", {"v": "REAL"})
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    flows.import_micro_batch(frame([("2024-01-01 00:00:00", "1")], "at string, v string"), 0, spec, path)
    flows.import_micro_batch(frame([("2024-01-02 00:00:00", "1", "x")], "at string, v string, w string"), 1, spec, path)
    flows.import_micro_batch(frame([("2024-01-02 00:00:00", "1", "y"), ("2024-01-02 00:00:00", "1", "x")], "at string, v string, w string"), 2, spec, path)
    flows.import_micro_batch(frame([("2024-01-01 00:00:00", "1"), ("2024-01-02 00:00:00", "1")], "at string, v string"), 3, spec, path)
    got = store.read_rows(spark, f"{path}/rows", "at")
    assert sorted((r["at"].day, r["v"], r["w"]) for r in got.fillna("-", ["w"]).collect()) == [(1, 1.0, "-"), (2, 1.0, "-"), (2, 1.0, "x"), (2, 1.0, "y")]
