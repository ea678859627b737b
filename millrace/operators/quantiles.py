"""Exact quantiles and modes without sorting and without holding a group in one task.

Wanted ranks are found by digits.  A digit is a number that grows with the value, so counts per digit tell which digit
holds a rank; only values with that digit are looked at again, with finer digits inside its smallest and largest value,
until a digit holds one value or few values are left.  Counts, smallest and largest values are added up before the
exchange, for all columns, groups and ranks at once, so neither rows nor hot groups are moved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.lookup import look_up
from millrace.session import settle

#: Digits of a factor of e in the first pass, and of a cell in every further one.
FIRST_DIGITS, NEXT_DIGITS = 1024, 65_536
#: Digit of NaN, which comes after all numbers.
LAST = (1 << 63) - 1
#: Cells with wanted ranks that go by way of the driver; more are written to the shared folder.
LOCAL = 10_000
#: Values left in all cells that are looked at one by one.
FEW = 1_000_000


def long_values(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, variable, value) rows of the non-null values of ``cols`` as doubles."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.variable", "_p.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def first_digit(value: Column) -> Column:
    """A whole number that grows with the value: about a thousand for every factor of e."""
    digit = (F.signum(value) * F.floor(FIRST_DIGITS * F.log1p(F.abs(value)))).cast("long")
    return F.when(F.isnan(value), F.lit(LAST)).otherwise(F.least(digit, F.lit(LAST - 1)))


def _located(cells: DataFrame, within: Sequence[str], by: str, positions) -> DataFrame:
    """Cells of ``within`` in the order ``by`` that hold wanted ranks: one row per cell and rank (``n``, ``pos``, ``at``).

    ``positions`` is null for cells of a cell: their ranks are in the column ``wanted`` then.
    """
    running = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(running), F.lit(0)))
    if positions is not None:
        cells = cells.withColumn("n", F.sum("_c").over(Window.partitionBy(*within)))
        wanted = F.transform(F.array_distinct(positions(F.col("n"))), lambda p: F.struct(p.cast("long").alias("pos"), p.cast("long").alias("at")))
        cells = cells.withColumn("wanted", wanted)
    inside = F.filter("wanted", lambda w: (w["at"] >= F.col("_before")) & (w["at"] < F.col("_before") + F.col("_c")))
    moved = F.transform(inside, lambda w: F.struct(w["pos"].alias("pos"), (w["at"] - F.col("_before")).alias("at")))
    return cells.withColumn("wanted", moved).where(F.size("wanted") > 0).drop("_before")


def ranked_values(long: DataFrame, groups: Sequence[str], positions, rows: int | None = None) -> DataFrame:
    """Values at wanted 0-based ranks: one row (groups, n, pos, value).

    ``positions`` maps a column ``n`` (group size) to an array column of wanted ranks.
    """
    groups = list(groups)
    long = long.select(*groups, "value").withColumn("_d", first_digit(F.col("value")))
    summary = [F.count("*").alias("_c"), F.min("value").alias("_lo"), F.max("value").alias("_hi")]
    cells = _Cells(_located(long.groupBy(*groups, "_d").agg(*summary), groups, "_d", positions))
    found = []
    while True:
        found.append(cells.done(groups))
        left = cells.left
        if not left:
            return reduce(DataFrame.union, [f for f in found if f is not None] or [cells.nothing(groups)])
        few = left <= FEW
        # a row belongs to the cell of its group and first digit whose ends it lies between
        renamed = cells.open().select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_d").alias("_cd"), "_lo", "_hi", "n", "wanted")
        on = [*[(F.col(g), f"_g_{g}") for g in groups], (F.col("_d"), "_cd")]
        if cells.rows is None:
            member = look_up(long, renamed, on, how="inner", null_safe=True, keep=lambda table: table)
        else:
            member = long.join(F.broadcast(renamed), [a.eqNullSafe(F.col(b)) for a, b in on], "inner").drop(*[b for _, b in on])
        member = member.where(F.col("value").between(F.col("_lo"), F.col("_hi")))
        share = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        finer = F.col("value") if few else F.floor(share * NEXT_DIGITS)
        cell = [*groups, "_d", "_lo", "_hi"]
        parts = member.groupBy(*cell, finer.alias("_f")).agg(F.first("n").alias("n"), F.first("wanted").alias("wanted"), F.count("*").alias("_c"), F.min("value").alias("_l"), F.max("value").alias("_h"))
        cells = _Cells(_located(parts, cell, "_f", None).drop("_f", "_lo", "_hi").withColumnsRenamed({"_l": "_lo", "_h": "_hi"}))


class _Cells:
    """Cells with wanted ranks, computed once: by way of the driver up to ``LOCAL`` of them, else through the shared folder."""

    def __init__(self, cells: DataFrame):
        self.spark, self.schema = cells.sparkSession, cells.schema
        rows = cells.limit(LOCAL + 1).collect()
        self.rows = rows if len(rows) <= LOCAL else None
        if self.rows is not None:
            self.left = sum(r["_c"] for r in rows if r["_lo"] < r["_hi"])
        else:
            self.table = settle(cells)
            self.left = self.table.where("_lo < _hi").agg(F.sum("_c")).first()[0] or 0

    def _local(self, rows: list, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame(rows, schema, verifySchema=False)

    def open(self) -> DataFrame:
        """Cells of several values."""
        return self.table.where("_lo < _hi") if self.rows is None else self._local([r for r in self.rows if r["_lo"] < r["_hi"]], self.schema)

    def _result(self, groups: Sequence[str]) -> T.StructType:
        kept = [self.schema[c] for c in (*groups, "n")]
        return T.StructType([*kept, T.StructField("pos", T.LongType()), T.StructField("value", T.DoubleType())])

    def nothing(self, groups: Sequence[str]) -> DataFrame:
        return self._local([], self._result(groups))

    def done(self, groups: Sequence[str]) -> DataFrame | None:
        """(groups, n, pos, value) of the ranks in cells of one value."""
        names = [*groups, "n"]
        if self.rows is None:
            picked = self.table.where("_lo >= _hi").select(*names, F.explode("wanted").alias("_w"), F.col("_lo").alias("value"))
            return picked.select(*names, F.col("_w.pos").alias("pos"), "value")
        rows = [(*[r[c] for c in names], w["pos"], r["_lo"]) for r in self.rows if not r["_lo"] < r["_hi"] for w in r["wanted"]]
        return self._local(rows, self._result(groups)) if rows else None


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    method: str | Sequence[str] = "linear",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact quantiles of each column per key: rows (keys, variable, <names>).

    ``linear`` interpolates between neighbours; ``midpoint`` takes their mean.  ``method`` may differ by quantile.
    """
    methods = [method] * len(probs) if isinstance(method, str) else list(method)
    names = list(names or [f"p{round(p * 100):d}" for p in probs])
    long = long_values(df, cols, keys)
    groups = [*keys, "variable"]

    def spot(n, p):
        return F.lit(float(p)) * (n - 1)

    def positions(n):
        return F.array(*[f(spot(n, p)).cast("long") for p in probs for f in (F.floor, F.ceil)])

    found = ranked_values(long, groups, positions)
    aggs = [F.first("n").alias("_n")]
    n = F.col("n")
    for i, p in enumerate(probs):
        aggs.append(F.max(F.when(F.col("pos") == F.floor(spot(n, p)), F.col("value"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(F.col("pos") == F.ceil(spot(n, p)), F.col("value"))).alias(f"_hi{i}"))
    wide = found.groupBy(*groups).agg(*aggs)
    out = []
    for i, (p, name, how) in enumerate(zip(probs, names, methods)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        at = spot(F.col("_n"), p)
        share = at - F.floor(at) if how == "linear" else F.lit(0.5)
        value = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * share)
        out.append(value.alias(name))
    return wide.select(*groups, *out)


def quantile_literals(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "linear") -> dict:
    """{column: tuple of quantiles}, fetched to the driver: one row per column."""
    names = [f"q{i}" for i in range(len(probs))]
    rows = quantiles(df, cols, probs, method=method, names=names).collect()
    return {r["variable"]: tuple(r[n] for n in names) for r in rows}


def modes(df: DataFrame, col: str, keys: Sequence[str] = (), out: str = "mode") -> DataFrame:
    """Most frequent value per key, lowest on ties, from value counts."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_c"))
    at = F.struct((-F.col("_c")).alias("c"), F.col(col).alias("v"))
    return counts.groupBy(*keys).agg(F.min_by(col, at).alias(out))
