"""Proposing links: order processes by how serials pass through them, then chain those that share serials."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordering
from millrace.operators.gram import summed_batches

#: Serials that a task turns into a matrix at once.
SERIALS = 1024
METHODS = ("count_keep_max", "count_keep_mean", "count_keep_all", "count_reversed", "function_count_reversed")


def newest_per_serial(df: DataFrame, process: str, serial: str, time: str, tie: str | None = None) -> DataFrame:
    """(process, serial, date): the newest record per process and serial."""
    rows = df.where(F.col(serial).isNotNull()).groupBy(F.col(process).alias("process"), F.col(serial).alias("serial"))
    return rows.agg(F.max(time).alias("date"))


def _with_counts(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("serial").agg(F.count("date").alias("count"))
    return rows.join(counts, "serial")


def _scored(rows: DataFrame) -> DataFrame:
    ordered = ordering.row_numbers(rows, ["date", ("process_rank", "desc")], ["serial"], "position")
    return ordered.groupBy("process").agg(F.avg("position").alias("score"), F.min("date").alias("first"))


def order_processes(rows: DataFrame, method: str = "count_keep_max") -> list[str]:
    """Processes from upstream to downstream.  Scores come from Spark, one number per process."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    names = sorted(r[0] for r in rows.select("process").distinct().collect())  # one row per configured process
    ranks = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], T.StructType([rows.schema["process"], T.StructField("process_rank", T.IntegerType())]))
    left = _with_counts(rows.join(F.broadcast(ranks), "process"))
    if method.endswith("reversed"):
        power = 3 if method.startswith("function") else 1
        numbered = ordering.row_numbers(left, [("date", "desc"), ("process_rank", "desc")], ["serial"], "position")
        score = F.sum(F.col("position") * F.pow(F.col("count").cast("double"), F.lit(power)))
        scores = numbered.groupBy("process").agg(score.alias("score"), F.min("date").alias("first")).collect()
        return [r["process"] for r in sorted(scores, key=lambda r: (-r["score"], r["first"], r["process"]))]
    if method == "count_keep_mean":
        mean = left.agg(F.avg("count")).first()[0]
        picked = left.where(F.col("count") >= F.lit(mean))
        return [r["process"] for r in sorted(_scored(picked).collect(), key=lambda r: (r["score"], r["first"], r["process"]))]
    out: list[str] = []
    while True:  # at most once per process
        most = left.agg(F.max("count")).first()[0]
        if most is None:
            return out
        scores = _scored(left.where(F.col("count") == most)).collect()
        found = [r["process"] for r in sorted(scores, key=lambda r: (r["score"], r["first"], r["process"]))]
        out += found
        if method == "count_keep_max":
            return out
        left = left.where(~F.col("process").isin(out))


def process_scores(rows: DataFrame) -> DataFrame:
    """(process, score, first): mean position among the serials seen by most processes."""
    names = sorted(r[0] for r in rows.select("process").distinct().collect())
    ranks = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], T.StructType([rows.schema["process"], T.StructField("process_rank", T.IntegerType())]))
    left = _with_counts(rows.join(F.broadcast(ranks), "process"))
    most = left.agg(F.max("count")).first()[0]
    return _scored(left.where(F.col("count") == most))


def shared_serials(rows: DataFrame, processes: Sequence[str]) -> DataFrame:
    """(a, b, shared): serials seen by both processes.

    One row per serial holds the numbers of its processes; tasks add up a matrix of all pairs with numpy, so there is no
    expression per pair, and a thousand processes are one pass.
    """
    spark, many = rows.sparkSession, len(processes)
    kind = rows.schema["process"]
    numbers = spark.createDataFrame([(p, i) for i, p in enumerate(processes)], T.StructType([kind, T.StructField("number", T.IntegerType())]))
    lists = rows.where(F.col("serial").isNotNull()).join(F.broadcast(numbers), "process").groupBy("serial").agg(F.collect_set("number").alias("numbers"))

    def both(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        column = batch.column("numbers")
        sizes, flat = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
        total, ends = np.zeros((many, many)), np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, len(sizes), SERIALS):
            part = sizes[at : at + SERIALS]
            seen = np.zeros((len(part), many), np.float32)
            seen[np.repeat(np.arange(len(part)), part), flat[ends[at] : ends[at + len(part)]]] = 1
            total += seen.T @ seen
        return {"shared": total}

    found = summed_batches(lists.select("numbers"), both).get("shared", np.zeros((many, many)))
    pairs = [(processes[i], processes[j], int(found[i, j])) for i in range(many) for j in range(i + 1, many)]
    schema = T.StructType([T.StructField("a", kind.dataType), T.StructField("b", kind.dataType), T.StructField("shared", T.LongType())])
    return spark.createDataFrame(pairs, schema)


def chains(rows: DataFrame, ordered: Sequence[str]) -> list[list[str]]:
    """Chains of processes: each joins the first chain that has a process sharing a serial with it, looking at the
    first members of all chains, then at the second ones, and so on."""
    if len(ordered) < 2:
        return [[p] for p in ordered]
    linked = {frozenset((r["a"], r["b"])) for r in shared_serials(rows, ordered).collect() if r["shared"]}
    out: list[list[str]] = []
    for process in ordered:
        spots = sorted((depth, n) for n, chain in enumerate(out) for depth, other in enumerate(chain) if frozenset((other, process)) in linked)
        if spots:
            out[spots[0][1]].append(process)
        else:
            out.append([process])
    return out


