"""Equi joins whose hot keys are dealt over several tasks, on either side.

A summary of frequent keys (bounded size, one pass, added up before the exchange) names the few keys that can hold more
than a given share of the rows; those are counted exactly.  Rows of such a key get a number among its pieces, and the
other side's rows of the key are repeated for each piece.  All other rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

#: A key is hot with more than one row in so many; there are at most as many hot keys.
SHARE = 64
#: Keys the summary keeps track of; its counts err by less than one row in so many.
TRACKED = 4096


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys, pieces) of the keys with more than a ``SHARE``-th of the rows; None if there are none.  Null keys are not counted."""
    known = df.select(*keys).dropna()
    top, rows = known.agg(F.expr(f"approx_top_k(xxhash64({', '.join(keys)}), {SHARE}, {TRACKED})"), F.count("*")).first()
    found = [r["item"] for r in top or [] if r["count"] * SHARE > rows]
    if not found:
        return None
    counted = known.where(F.xxhash64(*keys).isin(found)).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * SHARE > rows)
    return settle(counted.select(*keys, F.ceil(F.col("_n") * SHARE / F.lit(rows)).cast("int").alias("pieces")))


def _pieces(df: DataFrame, keys: Sequence[str], hot: DataFrame | None, hot_keys_: Sequence[str], out: str) -> DataFrame:
    """``df`` with the number of pieces of its key, 1 if it is not hot; at most ``SHARE`` rows are broadcast."""
    if hot is None:
        return df.withColumn(out, F.lit(1))
    table = hot.select(*[F.col(k).alias(f"_h_{k}") for k in hot_keys_], F.col("pieces").alias("_pieces"))
    cond = [F.col(a) == F.col(f"_h_{b}") for a, b in zip(keys, hot_keys_)]
    joined = df.join(F.broadcast(table), cond, "left").withColumn(out, F.coalesce("_pieces", F.lit(1)))
    return joined.drop("_pieces", *[f"_h_{k}" for k in hot_keys_])


def _number(df: DataFrame, count: str) -> Column:
    """Which piece a row is in; not a literal where there is one piece, which would be folded out of the join."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.col(count)).cast("int")


def spread_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], inner: bool, salts: int = 64, find: str = "lr") -> DataFrame:
    """``left`` joined with ``right`` on equal keys, inner or left; key columns stay, names of both sides must differ.

    Left rows without a key match nothing; they are spread over ``salts`` tasks, or dropped by an inner join.
    ``find`` names the sides whose hot keys are looked for, which reads the keys of that side once more: not needed for
    a side that has a key once, or for a left side that is itself a long plan (adaptive execution splits hot left keys).
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in left_keys])
    right = right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in right_keys]))
    left = left.where(known) if inner else left
    hot_left = hot_keys(left, left_keys) if "l" in find else None
    hot_right = hot_keys(right, right_keys) if "r" in find else None
    l = _pieces(_pieces(left, left_keys, hot_left, left_keys, "_lp"), left_keys, hot_right, right_keys, "_rp")
    r = _pieces(_pieces(right, right_keys, hot_left, left_keys, "_lp"), right_keys, hot_right, right_keys, "_rp")
    spread = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    l = l.withColumn("_ls", F.when(known, _number(left, "_lp")).otherwise(spread))
    r = r.withColumn("_rs2", _number(right, "_rp")).withColumn("_ls2", F.explode(F.sequence(F.lit(0), F.col("_lp") - 1))).drop("_lp", "_rp")
    cond = [F.col(a) == F.col(b) for a, b in zip(left_keys, right_keys)] + [F.col("_ls") == F.col("_ls2"), F.col("_rs") == F.col("_rs2")]
    one = l.withColumn("_rs", _number(left, "_rp"))
    if hot_right is None:
        out = one.join(r, cond, "inner" if inner else "left")
    else:
        # a left row of a key that is hot on the right has matches, so its copies for the pieces are joined inner
        many = l.where(F.col("_rp") > 1).withColumn("_rs", F.explode(F.sequence(F.lit(0), F.col("_rp") - 1)))
        out = one.where(F.col("_rp") == 1).join(r, cond, "inner" if inner else "left").union(many.select(*one.columns).join(r, cond, "inner"))
    return out.drop("_lp", "_rp", "_ls", "_rs", "_ls2", "_rs2")
