"""Histograms, kernel densities and earth mover's distances."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numeric import is_finite
from millrace.operators import ordering
from millrace.operators.quantiles import quantile_literals, quantiles
from millrace.operators.summary import join_on_keys, to_rows


def _finite(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.select(*keys, F.col(col).cast("double").alias("v")).where(is_finite(F.col("v")))


def bin_of(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin; the last bin is closed, values outside the range have none."""
    at = F.floor((value - F.lit(lo)) * F.lit(bins / (hi - lo)))
    return F.when((value >= lo) & (value <= hi), F.least(at, F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n) for every bin, empty ones included."""
    rows = _finite(df, col, keys)
    if lo is None or hi is None:
        a, b = rows.agg(F.min("v"), F.max("v")).first()
        lo, hi = (a if lo is None else lo), (b if hi is None else hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    counts = rows.select(*keys, bin_of(F.col("v"), lo, hi, bins).alias("bin")).where(F.col("bin").isNotNull())
    counts = counts.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    groups = rows.select(*keys).distinct() if keys else spark.range(1).select()
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = join_on_keys(grid, counts, [*keys, "bin"])
    edge = F.lit(lo) + F.col("bin") * F.lit((hi - lo) / bins)
    return out.select(*keys, "bin", edge.alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def bandwidths(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, sd, h): 1.06 · min(population sd, IQR/1.34) · n^-0.2 of column ``v``."""
    stats = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.stddev_pop("v").alias("sd"))
    shape = quantiles(rows, ["v"], [0.25, 0.75], keys, names=["_q1", "_q3"]).drop("variable")
    both = join_on_keys(stats, shape, keys)
    iqr = F.col("_q3") - F.col("_q1")
    spread = F.when(iqr == 0, F.col("sd")).otherwise(F.least(F.col("sd"), iqr / 1.34))
    return both.select(*keys, "n", "sd", (1.06 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))


def kernel_density(df: DataFrame, col: str, grid: Sequence[float], keys: Sequence[str] = (), height: float = 1.0) -> DataFrame:
    """(keys, grid, density) of a Gaussian kernel estimate over all rows.

    Equal values are counted first.  Each task then adds up kernels per grid point for its Arrow batches and sends on
    one row per batch and group, so nothing is repeated per grid point before the shuffle.
    """
    keys, points = list(keys), np.asarray(grid, dtype=float)
    rows = _finite(df, col, keys)
    h = bandwidths(rows, keys)
    weighted = rows.groupBy(*keys, "v").agg(F.count("*").cast("double").alias("w"))
    work = to_rows(weighted, h, keys).where(F.col("sd") > 0).select(*keys, "v", "w", "h")
    if keys:
        work = work.sortWithinPartitions(*keys)

    def kernels(part: pd.DataFrame) -> np.ndarray:
        total = np.zeros(len(points))
        v, w, width = (part[c].to_numpy() for c in ("v", "w", "h"))
        for start in range(0, len(v), 4096):
            cut = slice(start, start + 4096)
            z = (points[None, :] - v[cut, None]) / width[cut, None]
            total += w[cut] @ np.exp(-0.5 * z * z)
        return total

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            out = [(*key, kernels(part).tolist()) for key, part in groups if len(part)]
            if out:
                yield pd.DataFrame(out, columns=[*keys, "s"])

    schema = T.StructType([*work.select(*keys).schema.fields, T.StructField("s", T.ArrayType(T.DoubleType()))])
    cells = work.mapInPandas(partial, schema).select(*keys, F.posexplode("s").alias("i", "s"))
    sums = join_on_keys(cells.groupBy(*keys, "i").agg(F.sum("s").alias("s")), h, keys)
    at = F.get(F.array(*[F.lit(float(g)) for g in points]), F.col("i"))
    scale = F.lit(height / math.sqrt(2 * math.pi)) / (F.col("n") * F.col("h"))
    return sums.select(*keys, at.alias("grid"), (F.col("s") * scale).alias("density"))


def linear_grid(lo: float, hi: float, points: int = 128) -> list[float]:
    return [float(v) for v in np.linspace(lo, hi, points)]


def ridge_bounds(df: DataFrame, col: str, keys: Sequence[str]) -> tuple[float, float]:
    """Smallest mean - 2.5 sd and largest mean + 2.5 sd over groups."""
    groups = _finite(df, col, keys).groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return tuple(groups.agg(F.min(F.col("m") - 2.5 * F.col("s")), F.max(F.col("m") + 2.5 * F.col("s"))).first())


def ridgeline(df: DataFrame, col: str, keys: Sequence[str], bounds: tuple[float, float] | None = None, points: int = 128) -> DataFrame:
    """Density per group on a common grid, height 3, with the line's 0..1 share of its own maximum."""
    bounds = bounds or ridge_bounds(df, col, keys)
    lines = kernel_density(df, col, linear_grid(*bounds, points), keys, height=3.0)
    peak = lines.groupBy(*keys).agg(F.max("density").alias("_peak"))
    joined = join_on_keys(lines, peak, keys)
    return joined.withColumn("share", F.try_divide(F.col("density"), F.col("_peak"))).drop("_peak")


def emd(df: DataFrame, col: str, group: str, bins: int = 100, diff: bool = False, signed: bool = True) -> DataFrame:
    """(group, emd): distance of each group's histogram from the first group's (drift) or the previous one's (diff)."""
    rows = _finite(df, col, [group]).where(F.col(group).isNotNull())
    lo, hi = rows.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return df.select(group).limit(0).withColumn("emd", F.lit(0.0))
    if lo == hi:
        lo, hi = lo - 4, hi + 4
    at = bin_of(F.col("v"), lo, hi, bins)
    counts = rows.select(group, at.alias("bin")).groupBy(group, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("t"))
    filled = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    dens = join_on_keys(filled, counts, [group, "bin"]).select(
        group, "bin", (F.coalesce("n", F.lit(0)) / F.col("t")).alias("p")
    )
    # Each group is a row of at most ``bins`` numbers from here on.
    slots = F.sort_array(F.collect_list(F.struct("bin", "p")))
    dens = dens.groupBy(group).agg(F.transform(slots, lambda s: s["p"]).alias("d"))
    if diff:
        ref = ordering.shift(dens, "d", 1, [group], out="_ref").withColumn("_ref", F.coalesce("_ref", "d"))
    else:
        first = dens.agg(F.min_by("d", group)).first()[0]
        ref = dens.withColumn("_ref", F.array(*[F.lit(float(v)) for v in first]))
    change = F.zip_with("d", "_ref", lambda a, b: a - b)
    scale = F.lit((hi - lo) / (bins - 1))
    if signed:
        places = F.sequence(F.lit(1), F.lit(bins))
        total = F.aggregate(F.zip_with(change, places, lambda c, i: c * i), F.lit(0.0), lambda acc, v: acc + v)
    else:
        start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
        total = F.aggregate(
            change,
            start,
            lambda acc, v: F.struct((acc["run"] + v).alias("run"), (acc["sum"] + F.abs(acc["run"] + v)).alias("sum")),
            lambda acc: acc["sum"],
        )
    return ref.select(group, (total * scale).alias("emd"))


def emd_with_ng(df: DataFrame, cols: Sequence[str], group: str, rates: DataFrame, min_count: int = 1) -> DataFrame:
    """(group, variable, emd, ng_rate); with ``min_count``, a distance from fewer values is NULL."""
    parts = []
    for c in cols:
        sizes = _finite(df, c, [group]).groupBy(group).agg(F.count("*").alias("_n"))
        d = join_on_keys(emd(df, c, group), sizes, [group])
        parts.append(d.select(group, F.lit(c).alias("variable"), F.when(F.col("_n") >= min_count, F.col("emd")).alias("emd")))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return join_on_keys(merged, rates, [group])


def fenced_range(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per column the wider of min..max and midpoint quartiles ± 2.5 IQR."""
    found = quantile_literals(df, cols, [0.0, 0.25, 0.75, 1.0], "midpoint")
    out = {}
    for c, (lo, q1, q3, hi) in found.items():
        reach = 2.5 * (q3 - q1)
        out[c] = (min(lo, q1 - reach), max(hi, q3 + reach))
    return out


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """((bx, by, n) of occupied cells, the ranges used)."""
    rows = df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    rows = rows.where(is_finite(F.col(x)) & is_finite(F.col(y)))
    ranges = fenced_range(rows, [x, y])
    cells = rows.select(bin_of(F.col(x), *ranges[x], bins).alias("bx"), bin_of(F.col(y), *ranges[y], bins).alias("by"))
    return cells.groupBy("bx", "by").agg(F.count("*").alias("n")), ranges


def density_2d(df: DataFrame, x: str, y: str, bins: int = 50) -> tuple[np.ndarray, dict]:
    """Kernel density on the (bins+1)² grid points, as a small driver array, with the ranges used.

    The exact sum of one kernel per row at every size: equal points are counted first, then each task adds the
    kernels of its points to a grid of its own, and the grids are added up.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.where(is_finite(F.col("x")) & is_finite(F.col("y")))
    ranges = fenced_range(rows, ["x", "y"])
    stats = rows.agg(
        F.count("*"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y"), F.corr("x", "y")
    ).first()
    n, vx, vy, cxy, r = stats
    if not vx or not vy or abs(r) > 0.999:
        # A degenerate cloud gets a little width across, as jitter would give it.
        widths = [((hi - lo) / 50 or 0.01) ** 2 / 3 for lo, hi in (ranges["x"], ranges["y"])]
        vx, vy = (vx or 0.0) + widths[0], (vy or 0.0) + widths[1]
    points = rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("w"))
    cov = np.array([[vx, cxy], [cxy, vy]]) * n ** (-1.0 / 3.0)
    inverse, norm = np.linalg.inv(cov), 1.0 / (2 * math.pi * math.sqrt(np.linalg.det(cov)) * n)
    gx, gy = (np.linspace(*ranges[c], bins + 1) for c in ("x", "y"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(gx), len(gy)))
        for batch in batches:
            for start in range(0, len(batch), 256):
                px, py, w = (batch[c].to_numpy()[start : start + 256] for c in ("x", "y", "w"))
                dx, dy = gx[:, None] - px[None, :], gy[:, None] - py[None, :]
                ex = np.exp(-0.5 * inverse[0, 0] * dx * dx) * w
                ey = np.exp(-0.5 * inverse[1, 1] * dy * dy)
                if inverse[0, 1] == 0:
                    total += ex @ ey.T
                else:
                    cross = np.exp(
                        -0.5 * (inverse[0, 0] * (dx * dx)[:, None, :] + inverse[1, 1] * (dy * dy)[None, :, :])
                        - inverse[0, 1] * dx[:, None, :] * dy[None, :, :]
                    )
                    total += (cross * w).sum(axis=2)
        ij = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"i": ij[0], "j": ij[1], "s": total.ravel()})

    sums = points.mapInPandas(partial, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    grid = np.zeros((len(gx), len(gy)))
    for row in sums.collect():  # (bins + 1)² numbers
        grid[row["i"], row["j"]] = row["s"] * norm
    return grid, ranges


def sparse_points(df: DataFrame, x: str, y: str, bins: int = 50, share: float = 0.05, most: int | None = None) -> DataFrame:
    """Rows with ``low_density``: cells are taken from the thinnest on until more than ``share`` of the rows are in.

    ``most`` bounds the number of rows for a display.
    """
    grid, ranges = density_2d(df, x, y, bins)
    cells = (grid[:-1, :-1] + grid[1:, :-1] + grid[:-1, 1:] + grid[1:, 1:]) / 4.0
    bx, by = bin_of(F.col(x), *ranges["x"], bins), bin_of(F.col(y), *ranges["y"], bins)
    flagged = df.withColumn("_cell", bx * F.lit(bins) + by)
    counts = {r["_cell"]: r["n"] for r in flagged.where(F.col("_cell").isNotNull()).groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    limit = int(sum(counts.values()) * share)
    limit = limit if most is None else min(most, limit)
    thin, seen = [], 0
    for at in np.argsort(cells.ravel(), kind="stable"):
        thin.append(int(at))
        seen += counts.get(int(at), 0)
        if seen > limit:
            break
    occupied = [c for c in thin if c in counts]
    return flagged.withColumn("low_density", F.coalesce(F.col("_cell").isin(occupied), F.lit(False))).drop("_cell")


def contour(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """(gx, gy, z) grid points with z = ln(1000 · density / max + 1)."""
    grid, ranges = density_2d(df, x, y, bins)
    z = np.log(1000 * grid / grid.max() + 1)
    gx, gy = (np.linspace(*ranges[c], bins + 1) for c in ("x", "y"))
    rows = [(float(gx[i]), float(gy[j]), float(z[i, j])) for i in range(bins + 1) for j in range(bins + 1)]
    return df.sparkSession.createDataFrame(rows, "gx double, gy double, z double")


