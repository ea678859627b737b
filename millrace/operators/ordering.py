"""Order-dependent operators that never put a whole frame or a whole group into one task.

A window over all rows, or over one hot key, sorts everything in a single task.  Here rows are first split
into *range buckets* of (keys, order) whose bounds come from a sample, so a bucket is a bounded slice even when
one key holds a third of the data.  Windows run inside a bucket; what crosses a bucket edge (a count, a sum, a
last value) is one small row per bucket and edge key and is joined back.  The bounds only steer the balance:
results are the same for any bounds.  Frames below ``split_rows`` rows keep a single bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_ROWS_KEY = "spark.millrace.splitRows"
SPLIT_ROWS = 4_000_000
MAX_BUCKETS = 4096
SAMPLES_PER_BUCKET = 48

Order = Sequence[str | tuple[str, str]]


def split_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SPLIT_ROWS_KEY, str(SPLIT_ROWS)))


def order_items(order: Order) -> list[tuple[str, bool]]:
    """Normalise ``["a", ("b", "desc")]`` to ``[("a", False), ("b", True)]`` (name, descending)."""
    return [(o, False) if isinstance(o, str) else (o[0], o[1].lower() == "desc") for o in order]


def _ascending(df: DataFrame, name: str, desc: bool) -> list[Column]:
    """Expressions whose ascending order is the wanted order of one column, NULLs last."""
    c = F.col(name)
    if not desc:
        return [c.isNull(), c]
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return [c.isNull(), ~c]
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return [c.isNull(), -F.unix_micros(c.cast("timestamp"))]
    if isinstance(kind, T.NumericType):
        return [c.isNull(), -c]
    raise ValueError(f"descending order on {kind.simpleString()} column {name!r} is not supported")


@dataclass
class Buckets:
    """A frame with its sort key ``_o*`` and bucket ``_b``, and the key values met at bucket bounds."""

    df: DataFrame
    keys: list[str]
    sort: list[str]
    count: int
    rows: int
    edge_keys: list[tuple] = field(default_factory=list)

    @property
    def local(self) -> Window:
        return Window.partitionBy("_b", *self.keys).orderBy(*self.sort)

    def edges(self) -> DataFrame:
        """Rows whose key may continue in another bucket (all rows when there is no key)."""
        if not self.keys:
            return self.df
        spark = self.df.sparkSession
        schema = T.StructType([T.StructField(f"_k{i}", self.df.schema[k].dataType) for i, k in enumerate(self.keys)])
        known = spark.createDataFrame(self.edge_keys, schema)
        cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return self.df.join(F.broadcast(known), cond, "left_semi")

    def across(self) -> Window:
        """Window over the few (bucket, edge key) rows, in bucket order."""
        return Window.partitionBy(*self.keys).orderBy("_b") if self.keys else Window.orderBy("_b")

    def join_edges(self, left: DataFrame, small: DataFrame) -> DataFrame:
        """Left join one row per (bucket, edge key): at most about two rows per bucket, hence broadcast."""
        renamed = small.select(
            F.col("_b").alias("_eb"),
            *[F.col(k).alias(f"_ek{i}") for i, k in enumerate(self.keys)],
            *[F.col(c) for c in small.columns if c not in ("_b", *self.keys)],
        )
        cond = [F.col("_b") == F.col("_eb")]
        cond += [F.col(k).eqNullSafe(F.col(f"_ek{i}")) for i, k in enumerate(self.keys)]
        out = left.join(F.broadcast(renamed), cond, "left")
        return out.drop("_eb", *[f"_ek{i}" for i in range(len(self.keys))])

    def clean(self, df: DataFrame) -> DataFrame:
        return df.drop("_b", *self.sort)


def search_bucket(bounds: list, key: Column) -> Column:
    """Number of sorted bounds that are <= key, by binary search in a literal array."""
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*bounds)

    def step(at: Column, width: Column) -> Column:
        return F.when(F.get(table, at + width - 1) <= key, at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def buckets(df: DataFrame, order: Order, keys: Sequence[str] = (), rows: int | None = None) -> Buckets:
    """Assign range buckets over (keys, order).  Runs one count and, for large frames, one sampling job."""
    keys = list(keys)
    items = order_items(order)
    sort_exprs = [e for name, desc in items for e in _ascending(df, name, desc)]
    sort = [f"_o{i}" for i in range(len(sort_exprs))]
    framed = df.select("*", *[e.alias(s) for e, s in zip(sort_exprs, sort)])
    limit = split_rows(df)
    if rows is None:
        rows = df.select(*keys, *[n for n, _ in items]).count()
    wanted = min(MAX_BUCKETS, math.ceil(rows / limit)) if rows > limit else 1
    if wanted == 1:
        return Buckets(framed.withColumn("_b", F.lit(0)), keys, sort, 1, rows)

    parts = [c for i, k in enumerate(keys) for c in (F.col(k).isNull().alias(f"_n{i}"), F.col(k).alias(f"_v{i}"))]
    placing = framed.select(*parts, *sort)
    fraction = min(1.0, SAMPLES_PER_BUCKET * wanted / rows)
    sample = placing.sample(fraction=fraction, seed=7).sort(*placing.columns).collect()
    picked = []
    for i in range(1, wanted):
        at = i * len(sample) // wanted
        if at < len(sample) and (not picked or sample[at] != picked[-1]):
            picked.append(sample[at])
    if not picked:
        return Buckets(framed.withColumn("_b", F.lit(0)), keys, sort, 1, rows)
    types = [f.dataType for f in placing.schema.fields]
    literals = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(row, types, placing.columns)]) for row in picked
    ]
    key_struct = F.struct(*parts, *[F.col(s) for s in sort])
    placed = framed.withColumn("_b", search_bucket(literals, key_struct))
    edge_keys = list(dict.fromkeys(tuple(row[2 * i + 1] for i in range(len(keys))) for row in picked))
    return Buckets(placed, keys, sort, len(picked) + 1, rows, edge_keys)


def running_sum(
    df: DataFrame, value: str | Column, order: Order, keys: Sequence[str] = (), out: str = "running", rows: int | None = None
) -> DataFrame:
    """Cumulative sum of ``value`` up to and including each row, per key.  ``order`` should be total."""
    b = buckets(df, order, keys, rows)
    value = F.col(value) if isinstance(value, str) else value
    inside = F.sum(value).over(b.local.rowsBetween(Window.unboundedPreceding, 0))
    framed = b.df.withColumn(out, inside)
    if b.count > 1:
        before = F.sum("_part").over(b.across().rowsBetween(Window.unboundedPreceding, -1))
        small = b.edges().groupBy("_b", *b.keys).agg(F.sum(value).alias("_part")).withColumn("_pre_sum", before)
        framed = b.join_edges(framed, small.drop("_part"))
        framed = framed.withColumn(out, F.col(out) + F.coalesce("_pre_sum", F.lit(0))).drop("_pre_sum")
    return b.clean(framed)


def row_numbers(
    df: DataFrame, order: Order, keys: Sequence[str] = (), out: str = "rn", rows: int | None = None
) -> DataFrame:
    """1-based position of each row in ``order`` within its key group (or in the whole frame)."""
    return running_sum(df, F.lit(1).cast("long"), order, keys, out, rows)


def known_around(
    df: DataFrame,
    col: str,
    order: Order,
    keys: Sequence[str] = (),
    before: str | None = None,
    after: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add the last known value up to each row (``before``) and the first one from it on (``after``)."""
    b = buckets(df, order, keys, rows)
    upto = b.local.rowsBetween(Window.unboundedPreceding, 0)
    onward = b.local.rowsBetween(0, Window.unboundedFollowing)
    framed = b.df
    if before:
        framed = framed.withColumn(before, F.last(col, ignorenulls=True).over(upto))
    if after:
        framed = framed.withColumn(after, F.first(col, ignorenulls=True).over(onward))
    if b.count > 1:
        at = F.when(F.col(col).isNotNull(), F.struct(*b.sort))
        small = (
            b.edges().groupBy("_b", *b.keys).agg(F.max_by(col, at).alias("_last"), F.min_by(col, at).alias("_first"))
        )
        earlier = b.across().rowsBetween(Window.unboundedPreceding, -1)
        later = b.across().rowsBetween(1, Window.unboundedFollowing)
        small = small.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).withColumn(
            "_ahead", F.first("_first", ignorenulls=True).over(later)
        )
        framed = b.join_edges(framed, small.drop("_last", "_first"))
        if before:
            framed = framed.withColumn(before, F.coalesce(before, "_carry"))
        if after:
            framed = framed.withColumn(after, F.coalesce(after, "_ahead"))
        framed = framed.drop("_carry", "_ahead")
    return b.clean(framed)


def fill(
    df: DataFrame, col: str, order: Order, keys: Sequence[str] = (), forward: bool = True, out: str | None = None
) -> DataFrame:
    """Last (``forward``) or next known value of ``col`` in ``order``."""
    side = {"before": "_filled"} if forward else {"after": "_filled"}
    framed = known_around(df, col, order, keys, **side)
    return framed.withColumn(out or col, F.col("_filled")).drop("_filled")


def shift(
    df: DataFrame,
    col: str,
    offset: int,
    order: Order,
    keys: Sequence[str] = (),
    default=None,
    out: str | None = None,
) -> DataFrame:
    """Value ``offset`` rows earlier (later when negative) in ``order``, ``default`` outside the frame."""
    out = out or col
    kind = df.schema[col].dataType
    default = F.lit(default).cast(kind)
    if offset == 0:
        return df.withColumn(out, F.col(col))
    b = buckets(df, order, keys)
    if b.count == 1:
        moved = F.lag("_cell", offset) if offset > 0 else F.lead("_cell", -offset)
        cell = F.struct(F.col(col).alias("v"))
        framed = b.df.withColumn("_cell", cell).withColumn("_moved", moved.over(b.local))
        value = F.when(F.col("_moved").isNull(), default).otherwise(F.col("_moved.v"))
        return b.clean(framed.withColumn(out, value).drop("_cell", "_moved"))
    if abs(offset) == 1:
        framed = _neighbour(b, col, offset)
        value = F.when(F.col("_moved").isNull(), default).otherwise(F.col("_moved.v"))
        return b.clean(framed.withColumn(out, value).drop("_cell", "_moved"))
    numbered = row_numbers(df, order, keys, "_rn", b.rows)
    other = numbered.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        (F.col("_rn") + offset).alias("_at"),
        F.struct(F.col(col).alias("v")).alias("_cell"),
    )
    cond = [F.col("_rn") == F.col("_at")]
    cond += [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(other, cond, "left").drop(*[f"_k{i}" for i in range(len(list(keys)))], "_at")
    value = F.when(F.col("_cell").isNull(), default).otherwise(F.col("_cell.v"))
    return joined.withColumn(out, value).drop("_cell", "_rn")


def _neighbour(b: Buckets, col: str, offset: int) -> DataFrame:
    """``_moved``: cell of the row before (1) or after (-1); only bucket ends look into another bucket."""
    framed = b.df.withColumn("_cell", F.struct(F.col(col).alias("v")))
    inside = (F.lag("_cell") if offset > 0 else F.lead("_cell")).over(b.local)
    at = F.struct(*b.sort)
    pick = F.max_by if offset > 0 else F.min_by
    edge = F.struct(F.col(col).alias("v"))
    small = b.edges().groupBy("_b", *b.keys).agg(pick(edge, at).alias("_end"))
    beyond = F.lag("_end") if offset > 0 else F.lead("_end")
    small = small.withColumn("_beyond", beyond.over(b.across())).drop("_end")
    joined = b.join_edges(framed.withColumn("_moved", inside), small)
    return joined.withColumn("_moved", F.coalesce("_moved", "_beyond")).drop("_beyond")


def first_rows(df: DataFrame, keys: Sequence[str], order: Order, n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    Spark turns a filter on a small row number into a group limit before the shuffle, so each task sends at
    most ``n`` rows per key and a hot key stays small.
    """
    items = order_items(order)
    at = [e for name, desc in items for e in _ascending(df, name, desc)]
    window = Window.partitionBy(*keys).orderBy(*at)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
