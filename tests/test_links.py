"""Links against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import links
from millrace.plans.trace import LinkGraph, longest_paths
from millrace.spec import LinkEdge, LinkKey

T0 = datetime(2024, 1, 1)


def frames(spark, seed=3, n=60):
    rng = np.random.default_rng(seed)
    left = [(i, int(rng.integers(0, 3)) if i % 9 else None, T0 + timedelta(minutes=int(rng.integers(0, 200)))) for i in range(n)]
    right = [(100 + i, int(rng.choice([0, 0, 0, 1])), T0 + timedelta(minutes=int(rng.integers(0, 60)) * 5)) for i in range(n)]
    return left, right, spark.createDataFrame(left, "a long, ka long, ta timestamp"), spark.createDataFrame(right, "b long, kb long, tb timestamp")


@pytest.mark.parametrize("delta,cut", [(30, 20), (-15, 60), (5, 3), (10, 0), (-40, 10)])
def test_time_link(spark, buckets, delta, cut):
    left, right, l, r = frames(spark)
    got = {(x["a"], x["b"]) for x in links.time_link(l, r, "ta", "tb", delta, cut, [LinkKey("ka", "kb")]).collect()}
    want = set()
    for a, ka, ta in left:
        hits = []
        for b, kb, tb in right:
            away = tb - ta - timedelta(minutes=delta)
            if ka == kb and tb > ta and abs(away) < timedelta(minutes=cut):
                hits.append((abs(away), b))
        best = [b for d, b in hits if d == min(hits)[0]]
        want |= {(a, b) for b in best} or {(a, None)}
    assert got == want


def test_time_link_without_keys(spark, buckets):
    left, right, l, r = frames(spark, 8)
    out = links.time_link(l, r, "ta", "tb", 30, 10, filtered=True).collect()
    assert out and all(timedelta(minutes=20) < x["tb"] - x["ta"] < timedelta(minutes=40) for x in out)


def test_missing_keys_stay(spark):
    l = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "a long, k string")
    r = spark.createDataFrame([("x", 10), ("x", 11), (None, 12)], "j string, v long")
    out = links.equi_link(l, r, [LinkKey("k", "j")]).collect()
    assert sorted((x["a"], x["v"]) for x in out if x["v"]) == [(2, 10), (2, 11)]
    assert sorted(x["a"] for x in out if x["v"] is None) == [1, 3]
    assert links.equi_link(l, r, [LinkKey("k", "j")], filtered=True).count() == 2
    assert links.linked_rows(l, r, [LinkKey("k", "j")]).count() == 1


def test_substring_against_number(spark):
    l = spark.createDataFrame([("AB12",), ("CD99",)], "k string")
    r = spark.createDataFrame([(12, "hit")], "n long, v string")
    out = {x["k"]: x["v"] for x in links.equi_link(l, r, [LinkKey("k", "n", (3, 4))]).collect()}
    assert out == {"AB12": "hit", "CD99": None}


def graph():
    def edge(a, b, ka="s", kb="s", **kw):
        return LinkEdge(a, b, (LinkKey(ka, kb, **kw),))

    return LinkGraph([edge("p1", "p2"), edge("p2", "p3"), edge("p3", "p4", "s", "t"), edge("x", "p2", "s", "u")])


def test_paths():
    g = graph()
    assert g.paths("p1", "p4") == [["p1", "p2", "p3", "p4"]]
    assert g.paths("p4", "p1") == [["p4", "p3", "p2", "p1"]]
    assert g.paths("p1", "x") == [["p1", "p2", "x"]]
    # p2 and p3 are compared on the same column on both sides, so they pass the key through.
    assert g.shorten(["p1", "p2", "p3", "p4"]) == ["p1", "p4"]
    assert g.shorten(["p1", "p2", "p3", "p4"], needed=["p2"]) == ["p1", "p2", "p4"]
    assert g.chain(["p1", "p2", "p3", "p4"])[0].keys == (LinkKey("s", "t"),)
    assert g.shorten(["p1", "p2", "x"]) == ["p1", "p2", "x"]
    assert longest_paths([["a", "b"], ["a", "b", "c"], ["a", "d"]]) == [["a", "b", "c"], ["a", "d"]]


def test_time_links_are_never_merged():
    timed = LinkEdge("b", "c", (LinkKey("t", "t", delta_minutes=5, cut_off_minutes=1),))
    g = LinkGraph([LinkEdge("a", "b", (LinkKey("t", "t"),)), timed])
    assert g.shorten(["a", "b", "c"]) == ["a", "b", "c"]
    back = timed.reversed()
    assert (back.self_process, back.target_process) == ("c", "b")
    assert (back.keys[0].delta_minutes, back.keys[0].cut_off_minutes, back.keys[0].earlier) == (-5, 1, True)
    assert back.reversed() == timed


def test_one_row_per_key(spark, sf):
    from millrace.spec import DuplicateShow

    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    one = links.one_per_key(df, ["l_orderkey"], "l_shipdate", ["l_linenumber", "l_partkey"], DuplicateShow.FIRST)
    assert one.groupBy("l_orderkey").count().where(F.col("count") > 1).count() == 0
