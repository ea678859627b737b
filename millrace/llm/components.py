"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links(a, b)``.

    Alternates two steps until nothing changes: every node passes its smallest neighbour on to its larger
    neighbours, then to its smaller ones.  Only minima are aggregated, so a node with very many links is never
    gathered; the rounds grow with the logarithm of the longest path.  A link of a node with itself makes it a
    component of its own; nodes without links do not occur.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u >= v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = settle(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u >= v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = state
