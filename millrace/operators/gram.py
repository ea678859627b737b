"""Sums of products of many columns: block matrices from Arrow batches, and rows times matrices.

A task multiplies its batches with numpy and emits one row per block of the p × p matrix; blocks of all tasks are added
up by streams sorted by block.  There is no expression per pair of columns, so hundreds of columns are one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a block.
BLOCK = 128


def matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """Columns of a batch as doubles, NaN for null."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols]) if cols else np.empty((batch.num_rows, 0))


def _doubles(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(len(cols))]
    return df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)]), names


def summed(df: DataFrame, cols: Sequence[str], terms: Callable[[np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows of the matrices that ``terms`` makes of a batch (rows × columns, NaN for null).

    The sums, p × p doubles at most, reach the driver; one row per block and task is exchanged.
    """
    rows, names = _doubles(df, cols)
    return summed_batches(rows, lambda batch: terms(matrix(batch, names)))


def summed_batches(rows: DataFrame, terms: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows of the matrices of doubles that ``terms`` makes of a record batch."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for name, part in terms(batch).items():
                    total[name] = total[name] + part if name in total else part
        out: list[tuple] = []
        for name, whole in total.items():
            for i in range(0, whole.shape[0], BLOCK):
                for j in range(0, whole.shape[1], BLOCK):
                    out.append((f"{name} {i} {j}", np.ascontiguousarray(whole[i : i + BLOCK, j : j + BLOCK]).tobytes(), [*whole.shape]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["at", "block", "shape"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shape = None, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary()), pa.array([shape], pa.list_(pa.int32()))], ["at", "block", "shape"])

        for batch in batches:
            for at, block, size in zip(*(batch.column(c).to_pylist() for c in ("at", "block", "shape"))):
                part = np.frombuffer(block)
                if at != now:
                    if now is not None:
                        yield row()
                    now, held, shape = at, part.copy(), size
                else:
                    held += part
        if now is not None:
            yield row()

    schema = "at string, block binary, shape array<int>"
    blocks = rows.mapInArrow(multiply, schema).repartition("at").sortWithinPartitions("at").mapInArrow(add, schema).collect()
    out: dict[str, np.ndarray] = {}
    for r in blocks:
        name, i, j = r["at"].rsplit(" ", 2)
        whole = out.setdefault(name, np.zeros(r["shape"]))
        i, j = int(i), int(j)
        target = whole[i : i + BLOCK, j : j + BLOCK]
        target[:] = np.frombuffer(r["block"]).reshape(target.shape)
    return out


def with_columns(df: DataFrame, cols: Sequence[str], new: Sequence[str], work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with double columns ``new``: ``work`` turns a batch (rows × ``cols``) into (rows × ``new``)."""
    names = [f"_x{i}" for i in range(len(cols))]
    wide = df.select("*", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)])
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = work(matrix(batch, names))
                columns = [batch.column(f.name) for f in kept] + [pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(new))]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *new])

    return wide.mapInArrow(run, schema)


def pair_sums(df: DataFrame, cols: Sequence[str]) -> dict[str, np.ndarray]:
    """For each pair of columns over the rows where both are finite: n, and sums of x, x², and x·y (row: x, column: y).

    Values are taken from the mean of their column, so that the sums keep their digits.
    """
    centre = _means(df, cols)

    def terms(x: np.ndarray) -> dict[str, np.ndarray]:
        known = np.isfinite(x)
        z, m = np.where(known, x - centre, 0.0), known.astype(float)
        return {"n": m.T @ m, "x": z.T @ m, "xx": (z * z).T @ m, "xy": z.T @ z}

    p = len(cols)
    found = summed(df, cols, terms)
    return {k: found.get(k, np.zeros((p, p))) for k in ("n", "x", "xx", "xy")}


def _means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    def terms(x: np.ndarray) -> dict[str, np.ndarray]:
        known = np.isfinite(x)
        return {"n": known.sum(axis=0, keepdims=True).astype(float), "x": np.where(known, x, 0.0).sum(axis=0, keepdims=True)}

    found = summed(df, cols, terms)
    if not found:
        return np.zeros(len(cols))
    return (found["x"] / np.maximum(found["n"], 1))[0]


def complete_sums(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, sums of products of the deviations) over the rows in which all columns are finite."""
    p = len(cols)
    shift = _means(df, cols)

    def terms(x: np.ndarray) -> dict[str, np.ndarray]:
        z = x[np.isfinite(x).all(axis=1)] - shift
        return {"n": np.array([[float(len(z))]]), "x": z.sum(axis=0, keepdims=True), "xx": z.T @ z}

    found = summed(df, cols, terms)
    n = int(found["n"][0, 0]) if found else 0
    if not n:
        return 0, np.zeros(p), np.zeros((p, p))
    off = found["x"][0] / n
    return n, shift + off, found["xx"] - n * np.outer(off, off)
