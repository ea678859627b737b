from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import lookup
from millrace.operators.summary import full_summary, to_rows


def test_both_ways_agree(spark, monkeypatch):
    facts = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 5 == 0 else f"k{i % 7}") for i in range(500)], "id int, key string")
    table = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3), ("unused", 4)], "k string, v int")
    for null_safe in (False, True):
        results = []
        for most in (100_000, 0):
            monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)
            out = lookup.look_up(facts, table, [(F.col("key"), "k")], null_safe=null_safe)
            assert out.columns == ["id", "key", "v"]
            results.append(Counter(map(tuple, out.collect())))
        assert results[0] == results[1] and sum(results[0].values()) == 500
        assert any(v == 3 for _, _, v in results[0]) == null_safe


def test_facts_are_not_moved_by_their_group(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("y"), F.lit(1).alias("t"))
    stats = facts.groupBy("g").agg(F.max("y").alias("top"))
    plan = to_rows(facts, stats, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert full_summary(facts, "t", "y", ["g"]).count() == 3
