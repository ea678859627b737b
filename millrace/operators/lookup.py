"""Giving fact rows the values of a table with one row per key, without moving the fact rows by that key.

A join by a group key would deal all rows of a group to one task.  The table is written once and counted: up to a stated
number of rows it is broadcast; beyond, it is repeated per salt and the fact rows of each key are spread over the salts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

BROADCAST_ROWS = 100_000
SALTS = 32


def look_up(df: DataFrame, table: DataFrame, on: Sequence[tuple], how: str = "left", null_safe: bool = False, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``df`` joined with ``table`` on pairs (expression over df, column of table); those columns are dropped.

    Other columns of the table must not be named like those of ``df``.  ``keep`` stores the table, if it is not yet.
    """
    table = keep(table)
    pairs = [(left, F.col(right)) for left, right in on]
    cond = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    names = [right for _, right in on]
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), cond, how).drop(*names)
    salted = table.withColumn("_salt_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SALTS)).cast("int")
    out = df.withColumn("_salt_f", spread).join(salted, [*cond, F.col("_salt_f") == F.col("_salt_t")], how)
    return out.drop(*names, "_salt_f", "_salt_t")
