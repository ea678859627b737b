"""Nearest neighbours by inner product with a hash-prefix forest.

Every tree gives a vector a string of ``LENGTH`` hash bits (signs of random projections) and keeps its vectors as an
array sorted by these strings.  A query descends to its longest common prefix in every tree, which two binary searches
per prefix length find; then all trees ascend together, one bit at a time, and what shares the shortened prefix in any
tree becomes a candidate, until a wanted number of candidates is reached.  The candidates are ranked by their exact
inner products.

Largest inner products become smallest angles by one more coordinate: vectors are scaled to length at most one and
padded to length one, queries get a zero there.

The table is cut into blocks of bounded size by a hash of the id; each block has a forest of its own, built in a task,
and the stated queries meet every block, a bounded block of them at a time.  A block answers with its best rows, so what
travels is ``k`` rows per query and block, reduced before and after the exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle, written

TREES, LENGTH = 64, 32
#: Share of a block that ascending gathers at least.  Measured against brute force on vectors without any cluster
#: structure, where every method of this kind must look at a large part of the data to find nine tenths.
GATHER = 0.5
#: Bytes of vectors (as doubles) in a block and in a part of the queries, and blocks made at least.
BLOCK_BYTES, QUERY_BYTES, LEAST_BLOCKS = 32 << 20, 8 << 20, 32


class Forest:
    """Sorted arrays of hash strings over the rows of one block."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES, length: int = LENGTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.length = length
        self.planes = rng.standard_normal((trees, vectors.shape[1] + 1, length))
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1 - (scaled**2).sum(axis=1)))
        strings = self.strings(np.column_stack([scaled, rest]))
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, padded: np.ndarray) -> np.ndarray:
        """Hash strings as integers, first bit highest: (trees, rows)."""
        weights = np.uint64(1) << np.arange(self.length - 1, -1, -1, dtype=np.uint64)
        return np.stack([((padded @ p) > 0).astype(np.uint64) @ weights for p in self.planes])

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Row numbers per query: at least ``wanted`` of them, or all."""
        strings = self.strings(np.column_stack([queries, np.zeros(len(queries))]))
        rows = self.sorted.shape[1]
        # first and last row of each prefix length, tree and query
        low = np.empty((self.length + 1, *strings.shape), np.int32)
        high = np.empty_like(low)
        for kept in range(self.length + 1):
            free = np.uint64(self.length - kept)
            first = (strings >> free) << free
            last = first | ((np.uint64(1) << free) - np.uint64(1))
            for tree in range(len(strings)):
                low[kept, tree] = np.searchsorted(self.sorted[tree], first[tree], side="left")
                high[kept, tree] = np.searchsorted(self.sorted[tree], last[tree], side="right")
        most = (high - low).sum(axis=1, dtype=np.int64)  # with rows found by several trees counted for each
        for q in range(strings.shape[1]):
            found = np.zeros(rows, bool)
            for kept in range(self.length, -1, -1):
                if most[kept, q] >= wanted or not kept:
                    for tree, (a, b) in enumerate(zip(low[kept, :, q], high[kept, :, q])):
                        found[self.order[tree, a:b]] = True
                    if np.count_nonzero(found) >= wanted:
                        break
            yield np.flatnonzero(found)


def best(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the k best rows; ties to the smaller id.  Equal rows get equal products."""
    if len(rows) > 4 * k:
        rough = vectors[rows] @ query
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        rows = rows[rough >= edge - 1e-9 * max(1.0, abs(edge))]
    exact = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -exact))[:k]
    return ids[rows][order], exact[order]


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not all zero, all components present and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, queries: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", gather: float = GATHER, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k nearest other rows found.

    Nearness is the inner product in double precision, largest first, ties to the smaller id; with fewer candidates
    than k, all are returned.  Vectors that are null, zero, or hold null or non-finite components take no part, neither
    do rows with a null id, and a query of another length than a candidate does not meet it.  Rows that repeat an id
    are candidates each, but never of the query with that id.  An empty table gives an empty result.
    """
    values = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id).cast("long").alias("id"), values.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = written(rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v")))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.groupBy("size").agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.count_if("asks").alias("q")).filter("q > 0")
    blocks = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") * F.col("size") * 8 / BLOCK_BYTES))
    facts = settle(facts.select("size", "longest", blocks.alias("blocks"), F.ceil(F.col("q") * F.col("size") * 8 / QUERY_BYTES).alias("parts")))

    known = rows.join(facts, "size")
    block, part = F.pmod(F.xxhash64("id", "v"), F.col("blocks")), F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    candidates = known.select("size", block.alias("block"), numbers(F.col("parts")).alias("part"), "id", "v", "longest")
    asking = rows.filter("asks").groupBy("id").agg(F.min(F.struct("v", "size")).alias("s")).select("id", "s.*").join(facts, "size")
    asking = asking.select("size", part.alias("part"), numbers(F.col("blocks")).alias("block"), "id", "v").toDF("q_size", "q_part", "q_block", "q_id", "q_v")

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = left["id"].to_numpy()
        found: list[tuple] = []
        if len(left) and len(right):
            vectors = np.stack(left["v"].to_numpy())
            forest = Forest(vectors, float(left["longest"].iloc[0]), trees)
            wanted = min(len(ids), max(4 * k, int(np.ceil(gather * len(ids)))))
            for at in range(0, len(right), 256):
                asked = np.stack(right["q_v"].iloc[at : at + 256].to_numpy())
                for query_id, query, near in zip(right["q_id"].iloc[at : at + 256], asked, forest.candidates(asked, wanted)):
                    found.append((query_id, *best(vectors, ids, query, near[ids[near] != query_id], k)))
        none = np.empty(0)
        return pd.DataFrame({
            "query_id": np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found]),
            "vec_id": np.concatenate([f[1] for f in found] or [none]).astype(np.int64),
            "score": np.concatenate([f[2] for f in found] or [none]),
        })

    keys = ["size", "block", "part"]
    found = candidates.groupBy(*keys).cogroup(asking.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
