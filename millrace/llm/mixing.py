"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Where the target is ``r`` times the source, each document is certain to be
taken ``floor(r)`` times, and the rest of the target is a sample without replacement with unequal inclusion
probabilities: longer documents (by size class, powers of two) are likelier, as the square root of their length, up to
certainty.  A document with probability ``p`` and a keyed random number ``u`` has rank ``(u / (1 - u)) / (p / (1 - p))``;
the documents of lowest rank are the sample.  Its size is fixed in words: the cut is put after the last document that
still fits into the rest of the target; documents beyond it that are no longer than the gap are cut once more in the same
order, and again; at last the one document whose length is nearest to the remaining gap is added.

The cut of a source is found by counting words per interval of ranks, then inside the interval that holds the cut, and
so on, so neither a source nor its ranks are sorted or gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle, written

#: No document is taken more often than this.
MOST_COPIES = 3
#: Intervals per pass over the ranks, and passes before the few documents around the cut are put in order.
INTERVALS, PASSES = 1024, 3
#: Tables of one row per source, or per source and size class, are broadcast up to so many sources.
BROADCAST_SOURCES = 20_000
#: Cuts, each among documents no longer than the gap that the one before left.
CUTS = 3


def targets(sizes: DataFrame, weights: Sequence[float], most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, none above ``most`` times its source.

    ``sizes(source, source_size)`` has one row per source.  Sources in code point order, null last, weigh
    ``weights`` in turn.  The excess over a limit is shared again by weight: sources are limited in the order of
    ``limit / weight``, so the level ``target / weight`` of all others follows from two running sums.  The windows
    run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights)))
    weighed = weighed.withColumn("limit", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    ahead, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, weight = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    level = (total - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / (weight - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("at", F.row_number().over(order))
    levels = levels.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("at"))).over(whole))
    top = F.max(F.when(F.col("at") == F.col("first"), F.col("level"))).over(whole)
    return levels.select("source", "source_size", F.when(F.col("at") >= F.col("first"), top * F.col("weight")).otherwise(F.col("limit")).alias("target"))


def inclusion(classes: DataFrame) -> DataFrame:
    """(source, class, p): inclusion probabilities whose expected words are the rest of the target.

    ``classes(source, class, words, rest)`` has one row per source and size class (at most 64 per source).  The
    weight of a class is ``2 ** (class / 2)``.  Classes are certain from the largest down until the others' share
    stays within one.
    """
    above = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(0, Window.unboundedFollowing)
    pull = F.pow(F.lit(2.0), F.col("class") / 2)
    left = F.col("rest") - F.coalesce(F.sum("words").over(above), F.lit(0))
    scaled = classes.withColumn("pull", pull).withColumn("scale", left / F.sum(F.col("words") * pull).over(from_here))
    whole = Window.partitionBy("source")
    fits = F.when(F.col("scale") * F.col("pull") <= 1, F.col("scale"))
    first = F.max_by(fits, F.when(fits.isNotNull(), F.col("class"))).over(whole)
    cut = F.max(F.when(fits.isNotNull(), F.col("class"))).over(whole)
    p = F.when(F.col("class") > cut, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), first * F.col("pull")))
    return scaled.select("source", "class", F.coalesce(p, F.lit(1.0)).alias("p"))


def rank(p: Column, *keys: Column) -> Column:
    """Pareto rank mapped to (0, 1): below one half for ``u < p``.  0 for certain and 1 for impossible documents."""
    u = (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) * (2.0**-53)
    odds = (u / (1 - u)) * (1 - p) / p
    return F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1.0)).otherwise(odds / (1 + odds))


def _cuts(ranked: DataFrame, rests: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, cut, gap): ranks up to the cut fit into the rest and leave a gap; no row for a source without a rest.

    Every pass cuts the interval (low, high] known to hold the cut into equal parts and keeps the part in which the
    running sum of words passes the rest; ``below`` words lie at or under ``low``.
    """
    bounds = rests.filter("rest > 0").select("source", "rest", F.lit(-1e-9).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("below"))
    bounds = settle(bounds)
    for _ in range(PASSES):
        inside = ranked.join(small(bounds.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).filter("rank > low and rank <= high")
        part = F.least(F.floor((F.col("rank") - F.col("low")) / (F.col("high") - F.col("low")) * INTERVALS), F.lit(INTERVALS - 1))
        grouped = inside.groupBy("source", part.alias("part")).agg(
            F.sum("size").alias("words"), F.min("rank").alias("least"), F.max("rank").alias("most"), *[F.first(c).alias(c) for c in ("rest", "low", "high", "below")]
        )
        running = Window.partitionBy("source").orderBy("part")
        grouped = grouped.withColumn("reach", F.col("below") + F.sum("words").over(running)).withColumn("prior", F.lag("most").over(running))
        last = F.max("part").over(Window.partitionBy("source"))
        hit = grouped.withColumn("good", (F.col("reach") >= F.col("rest")) | (F.col("part") == last))
        first = hit.groupBy("source").agg(F.min_by(F.struct("rest", F.coalesce("prior", "low").alias("low"), F.col("most").alias("high"), (F.col("reach") - F.col("words")).alias("below")), F.when(F.col("good"), F.col("part"))).alias("b"))
        bounds = settle(first.select("source", "b.*"))
    near = ranked.join(small(bounds.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).filter("rank > low and rank <= high")
    ties = near.groupBy("source", "rank").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("rest", "low", "below")])
    running = Window.partitionBy("source").orderBy("rank")
    after = ties.select("source", "rank", "rest", (F.col("below") + F.sum("words").over(running)).alias("taken"))
    start = bounds.select("source", F.col("low").alias("rank"), "rest", F.col("below").alias("taken"))
    options = start.union(after)
    best = options.filter("taken <= rest").groupBy("source").agg(F.max(F.struct("rank", (F.col("rest") - F.col("taken")).alias("gap"))).alias("b"))
    return best.select("source", F.col("b.rank").alias("cut"), "b.gap")


def mix(df: DataFrame, weights: Sequence[float], size: Column, source: str = "source", id: str = "doc_id", seed: int = 7, key: Sequence[str] = ()) -> DataFrame:
    """Copies of each row that bring every source to its target.

    Returns (id, *key, source, size, source_size, target, copies).  ``size`` is an expression in words; rows of null
    or zero size are taken ``floor(target / source_size)`` times, which adds no words.  A source whose rows are all
    empty has target 0 and no copies.  The random number of a row depends on seed, source, id and ``key`` only, so
    reruns agree; rows equal in these share their fate.  Null ids and null sources are values like any other.  An
    empty table gives an empty result.
    """
    rows = df.select(F.col(id).alias("id"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(source).alias("source"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"))
    rows = written(rows)
    shares = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = shares.withColumn("sure", F.floor(ratio + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size")))

    few = shares.count() <= BROADCAST_SOURCES

    def small(table: DataFrame) -> DataFrame:
        """A table of some rows per source, to be broadcast unless there are very many sources."""
        return F.broadcast(table) if few else table

    def by_source(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        right = right.withColumnsRenamed({c: f"_{c}" for c in ("source", *on)})
        cond = F.col("source").eqNullSafe(F.col("_source"))
        for c in on:
            cond &= F.col(c) == F.col(f"_{c}")
        return left.join(small(right), cond, "left").drop("_source", *[f"_{c}" for c in on])

    length = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double"))).cast("int")).otherwise(F.lit(-1))
    rows = rows.withColumn("class", length)
    classes = rows.filter("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    chances = settle(by_source(inclusion(by_source(classes, shares.select("source", "rest"))), shares))
    plain = by_source(rows, shares)
    p = by_source(plain, chances.select("source", "class", "p"), "class")
    keys = [F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("id"), *[F.col(f"k{i}") for i in range(len(key))]]
    ranked = written(p.withColumn("rank", rank(F.coalesce(F.when(F.col("rest") > 0, F.col("p")), F.lit(0.0)), *keys)))
    partly = ranked.filter("size > 0 and rest > 0").select("source", "size", "rank")
    state = settle(shares.filter("rest > 0").select("source", F.lit(-1.0).alias("cut0"), F.lit(float("inf")).alias("gap0"), F.col("rest").alias("left0")))
    for k in range(CUTS):
        left = by_source(partly, state).filter((F.col("rank") > F.col(f"cut{k}")) & (F.col("size") <= F.col(f"gap{k}")))
        found = _cuts(left.select("source", "size", "rank"), state.select("source", F.col(f"left{k}").alias("rest")), small)
        state = by_source(state, found)
        state = settle(state.withColumns({f"cut{k + 1}": F.coalesce("cut", f"cut{k}"), f"gap{k + 1}": F.coalesce("gap", f"left{k}"), f"left{k + 1}": F.coalesce("gap", f"left{k}")}).drop("cut", "gap"))
    taken = F.lit(False)
    for k in range(CUTS):
        taken |= (F.col("rank") > F.col(f"cut{k}")) & (F.col("rank") <= F.col(f"cut{k + 1}")) & (F.col("size") <= F.col(f"gap{k}"))
    last = F.col(f"gap{CUTS}")
    off = F.abs(F.col("size") - last)
    nearest = by_source(partly, state).filter(~taken & (off < last))
    fill = nearest.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "size")).alias("f"))
    state = settle(by_source(state, fill.select("source", F.col("f.rank").alias("fill"), F.col("f.size").alias("fill_size"))))
    out = by_source(ranked, state)
    filled = (F.col("rank") == F.col("fill")) & (F.col("size") == F.col("fill_size"))
    extra = F.coalesce((F.col("size") > 0) & (F.col("rest") > 0) & (taken | F.coalesce(filled, F.lit(False))), F.lit(False)).cast("long")
    return out.select(
        F.col("id").alias(id), *[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], F.col("source").alias(source), "size", "source_size", "target", (F.col("sure") + extra).alias("copies")
    )


def repeat(df: DataFrame, weights: Sequence[float], size: Column, source: str = "source", id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """``df`` with every row repeated as often as the mix takes it; rows are told apart by id, source and text."""
    key = F.xxhash64(F.col(text).cast("string"))
    copies = mix(df.withColumn("_key", key), weights, size, source, id, seed, ["_key"])
    copies = copies.filter("copies > 0").select(F.col(id).alias("_id"), F.col(source).alias("_source"), "_key", F.col("copies").alias("_copies")).distinct()
    same = F.col(id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")) & (key == F.col("_key"))
    return df.join(copies, same).withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*df.columns)
