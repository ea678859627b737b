"""Summary statistics, process capability and axis ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import is_finite
from millrace.operators.lookup import look_up
from millrace.operators.quantiles import modes, quantile_literals, quantiles


@dataclass(frozen=True)
class Limits:
    """Control and process limits with their validity period [act_from, act_to)."""

    low: float | None = None
    high: float | None = None
    process_low: float | None = None
    process_high: float | None = None
    act_from: datetime | None = None
    act_to: datetime | None = None


def join_on_keys(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add per-group columns to a table of groups; ``to_rows`` does so for fact rows."""
    if not keys:
        row = stats.first()
        return df.withColumns({c: F.lit(row[c] if row else None).cast(t) for c, t in stats.dtypes})
    renamed = stats.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    return df.join(renamed, cond, how).drop(*[f"_j_{k}" for k in keys])


def to_rows(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add per-group columns to fact rows, which are not moved by their group."""
    if not keys:
        return join_on_keys(df, stats, keys)
    renamed = stats.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    return look_up(df, renamed, [(F.col(k), f"_j_{k}") for k in keys], null_safe=True)


def basic_stats(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, variable, n, mean, sigma, minimum, maximum, p25, median, p75) over finite values."""
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.variable", "_p.value")
    groups = [*keys, "variable"]
    x = F.when(is_finite(F.col("value")), F.col("value"))
    plain = long.groupBy(*groups).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sigma"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
    )
    finite = df.withColumns({c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols})
    shape = quantiles(finite, cols, [0.25, 0.5, 0.75], keys, names=["p25", "median", "p75"])
    return join_on_keys(plain, shape, groups)


def _number(v: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST('{float(v)!r}' AS DOUBLE)"


def _count_beyond(sign: str, v: float | None) -> str:
    return "CAST(0 AS BIGINT)" if v is None else f"count_if(_f {sign} {_number(v)})"


def _capability(limits: Limits, mean: str, sigma: str) -> tuple[str, str]:
    """SQL of Cp and Cpk; NULL without both limits or without spread."""
    if limits.low is None or limits.high is None:
        return _number(None), _number(None)
    lo, hi, three = _number(limits.low), _number(limits.high), f"nullif(3 * {sigma}, 0)"
    cp = f"try_divide({hi} - {lo}, nullif(6 * {sigma}, 0))"
    return cp, f"least(try_divide({hi} - {mean}, {three}), try_divide({mean} - {lo}, {three}))"


def validity(df: DataFrame, x: str, limits: Limits) -> Column:
    """Whether a row is inside the validity period; all rows are when it covers every event time (or none is given)."""
    if limits.act_from is None and limits.act_to is None:
        return F.lit(True)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return F.lit(True)
    start, end = limits.act_from or datetime.min, limits.act_to or datetime.max
    if start <= lo and hi <= end:
        return F.lit(True)
    test = F.col(x).isNotNull()
    if limits.act_from is not None:
        test = test & (F.col(x) >= F.lit(limits.act_from).cast("timestamp"))
    if limits.act_to is not None:
        test = test & (F.col(x) < F.lit(limits.act_to).cast("timestamp"))
    return test


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables of one row, or none, as one of one row."""
    row, other = a.first(), b.first()
    nothing = {c: F.lit(None).cast(t) for c, t in [*a.dtypes, *b.dtypes]}
    known = (row.asDict() if row else {}) | (other.asDict() if other else {})
    return a.sparkSession.range(1).select(*[F.lit(known.get(c)).cast(dict([*a.dtypes, *b.dtypes])[c]).alias(c) for c in nothing])


def full_summary(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), limits: Limits = Limits()) -> DataFrame:
    """Counts, basic and non-parametric statistics of ``y`` per key; ``x`` is the event time (NULL = unlinked).

    The exact percentiles of both kinds are found together; one aggregation then computes the rest, with the statistics
    trimmed to Q1 - 2.5 IQR .. Q3 + 2.5 IQR.
    """
    keys = list(keys)
    base = df.select(*keys, F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))
    base = base.withColumn("_f", F.when(is_finite(F.col("_y")), F.col("_y")))
    names = ["p5", "p25", "median", "p75", "p95"]
    probs, methods = [0.05, 0.25, 0.5, 0.75, 0.95, 0.25, 0.75], ["linear"] * 5 + ["midpoint"] * 2
    valid = validity(base, "_x", limits)
    # quantiles of the valid rows, and midpoints of all
    base = base.withColumns({"_valid": valid, "_g": F.when(valid, F.col("_f"))})
    base = base.withColumns({"_a": F.col("_f"), "_y": F.when(valid, F.col("_y"))}).drop("_f").withColumnRenamed("_g", "_f")
    columns = ["_f", "_a"] if limits.act_from is not None or limits.act_to is not None else ["_f"]
    found = quantiles(base, columns, probs, keys, methods, [*names, "_m1", "_m3"])
    middle = found.where(F.col("variable") == columns[-1]).select(*keys, "_m1", "_m3")
    shape = found.where("variable = '_f'").drop("variable", "_m1", "_m3")
    work = to_rows(base, join_on_keys(middle, shape, keys) if keys else _side_by_side(middle, shape), keys)
    trimmed = "_f BETWEEN p25 - 2.5D * (p75 - p25) AND p75 + 2.5D * (p75 - p25)"
    work = work.withColumn("_t", F.expr(f"CASE WHEN {trimmed} THEN _f END"))
    measures = {
        "num_over_upper": "count_if(_m3 <> _m1 AND _a > _m3 + 4.5D * (_m3 - _m1))",
        "num_over_lower": "count_if(_m3 <> _m1 AND _a < _m1 - 4.5D * (_m3 - _m1))",
        "ntotal": "count_if(_valid)",
        "count_unlinked": "count_if(_valid AND _x IS NULL)",
        "pn_plus": _count_beyond(">=", limits.high),
        "pn_minus": _count_beyond("<=", limits.low),
        "pn_proc_plus": _count_beyond(">=", limits.process_high),
        "pn_proc_minus": _count_beyond("<=", limits.process_low),
        "_nulls": "count_if(_valid AND (_y IS NULL OR isnan(_y)))",
        "pn_inf": "count_if(_y = double('Infinity'))",
        "pn_neg_inf": "count_if(_y = double('-Infinity'))",
        "average": "avg(_f)",
        "sigma": "stddev_samp(_f)",
        "minimum": "min(_f)",
        "maximum": "max(_f)",
        "t_n_stats": "count(_t)",
        "t_average": "avg(_t)",
        "t_sigma": "stddev_samp(_t)",
        "t_minimum": "min(_t)",
        "t_maximum": "max(_t)",
        **{n: f"first({n})" for n in names},
    }
    agg = work.groupBy(*keys).agg(*[F.expr(f"{sql} AS {name}") for name, sql in measures.items()])
    if keys:  # a group without valid rows is no group
        agg = agg.where("ntotal > 0")
    mode = modes(base, "_f", keys, "mode")
    agg = join_on_keys(agg, mode, keys)
    counted = agg.selectExpr(
        "*",
        "pn_plus + pn_minus AS pn",
        "pn_proc_plus + pn_proc_minus AS pn_proc",
        "_nulls - count_unlinked AS pn_na",
        "_nulls - count_unlinked + pn_inf + pn_neg_inf AS _abnormal",
        "p75 - p25 AS iqr",
    )
    cp, cpk = _capability(limits, "average", "sigma")
    t_cp, t_cpk = _capability(limits, "t_average", "t_sigma")
    shares = ["plus", "minus", "proc_plus", "proc_minus", "inf", "neg_inf", "na", "proc"]
    sides = [
        f"{p}average {sign} {k} * {p}sigma AS {p}avg_{word}_{'' if k == 1 else k}sigma"
        for p in ("", "t_")
        for k in (1, 3)
        for sign, word in (("+", "p"), ("-", "m"))
    ]
    return counted.selectExpr(
        "* EXCEPT (_nulls, _abnormal)",
        "greatest(pn, pn_proc) + _abnormal AS pn_total",
        "try_divide(100.0D * (greatest(pn, pn_proc) + _abnormal), ntotal) AS p_total",
        "try_divide(100.0D * pn, ntotal) AS p",
        *[f"try_divide(100.0D * pn_{s}, ntotal) AS p_{s}" for s in shares],
        "greatest(ntotal - _abnormal, 0) AS n_stats",
        f"{cp} AS cp",
        f"{cpk} AS cpk",
        f"{t_cp} AS t_cp",
        f"{t_cpk} AS t_cpk",
        "0.7413D * iqr AS niqr",
        "p25 - 1.5D * iqr AS whisker_lower",
        "p75 + 1.5D * iqr AS whisker_upper",
        "p25 - 2.5D * iqr AS lower_range",
        "p75 + 2.5D * iqr AS upper_range",
        "try_divide(100.0D * (ntotal - count_unlinked), ntotal) AS linked_pct",
        *sides,
    )


def overflow_bounds(df: DataFrame, y: str) -> tuple[float, float] | None:
    """Midpoint quartiles ± 4.5 IQR over finite values; None without spread."""
    found = _midpoints(df, y)
    if found is None or found[0] == found[1]:
        return None
    q1, q3 = found
    return q1 - 4.5 * (q3 - q1), q3 + 4.5 * (q3 - q1)


def _midpoints(df: DataFrame, y: str):
    finite = df.select(F.col(y).cast("double").alias("v")).where(is_finite(F.col("v")))
    return quantile_literals(finite, ["v"], [0.25, 0.75], "midpoint").get("v")


def axis_range(df: DataFrame, y: str) -> tuple[float, float] | None:
    """Midpoint quartiles ± 2.5 IQR; without spread 0.9 min .. 1.1 max."""
    found = _midpoints(df, y)
    if found is None:
        return None
    q1, q3 = found
    if q1 != q3:
        return q1 - 2.5 * (q3 - q1), q3 + 2.5 * (q3 - q1)
    finite = df.where(is_finite(F.col(y).cast("double")))
    lo, hi = finite.agg(F.min(y), F.max(y)).first()
    lo, hi = 0.9 * lo, 1.1 * hi
    return (lo - 1, hi + 1) if lo == hi else (lo, hi)


def widened(lo: float | None, hi: float | None) -> tuple[float, float]:
    """A non-empty display range."""
    if hi is None:
        hi = lo * 1.2 if lo is not None else 1
    if lo is None:
        lo = hi * 0.8
    if lo == hi:
        lo, hi = lo * 0.8, hi * 1.2
    return (-1, 1) if lo == 0 and hi == 0 else (lo, hi)


def scales(df: DataFrame, cols: Sequence[str], limits: dict[str, Limits] | None = None) -> DataFrame:
    """(variable, scale, y_min, y_max, lower_outliers, upper_outliers) for the five display scales."""
    limits = limits or {}
    finite = df.select(*[F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    ends = finite.agg(*[f(c).alias(f"{c}_{n}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    quarter = quantile_literals(finite, cols, [0.25, 0.75])
    known = [c for c in cols if c in quarter]
    common = widened(
        min((ends[f"{c}_lo"] for c in known), default=None), max((ends[f"{c}_hi"] for c in known), default=None)
    )
    plan: list[tuple[str, str, float, float, float | None, float | None]] = []
    for c in known:
        lo, hi, (q1, q3) = ends[f"{c}_lo"], ends[f"{c}_hi"], quarter[c]
        cut_lo, cut_hi = q1 - 2.5 * (q3 - q1), q3 + 2.5 * (q3 - q1)
        show_lo, show_hi = (max(0, cut_lo) if lo >= 0 else cut_lo), (min(0, cut_hi) if hi <= 0 else cut_hi)
        auto = (*widened(show_lo, show_hi), *((None, None) if cut_lo == cut_hi else (cut_lo, cut_hi)))
        lim = limits.get(c)
        setting = threshold = auto if lim else (lo, hi, None, None)
        if lim and (lim.process_low is not None or lim.process_high is not None):
            a = auto[0] if lim.process_low is None else lim.process_low
            b = auto[1] if lim.process_high is None else lim.process_high
            setting = (*widened(a, b), auto[2] if lim.process_low is None else a, auto[3] if lim.process_high is None else b)
        if lim and (lim.low is not None or lim.high is not None):
            fall = axis_range(finite, c)
            a, b = (fall[0] if lim.low is None else lim.low), (fall[1] if lim.high is None else lim.high)
            margin = (b - a) * 0.1
            threshold = (a, b, a - margin, b + margin)
        elif not lim:
            threshold = auto
            setting = auto
        full = (*widened(lo, hi), None, None)
        for name, s in zip(("auto", "setting", "threshold", "common", "full"), (auto, setting, threshold, (*common, None, None), full)):
            plan.append((c, name, *s))
    counted = finite.agg(
        *[F.count_if(F.col(c) < lo if lo is not None else F.lit(False)).alias(f"l{i}") for i, (c, _, _, _, lo, _) in enumerate(plan)],
        *[F.count_if(F.col(c) > hi if hi is not None else F.lit(False)).alias(f"u{i}") for i, (c, _, _, _, _, hi) in enumerate(plan)],
    ).first()
    rows = [(c, n, float(a), float(b), counted[f"l{i}"], counted[f"u{i}"]) for i, (c, n, a, b, _, _) in enumerate(plan)]
    schema = "variable string, scale string, y_min double, y_max double, lower_outliers long, upper_outliers long"
    return df.sparkSession.createDataFrame(rows, schema)
