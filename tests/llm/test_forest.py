import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, block int, size int"


def table(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "i", "v", 2, 3) for i, v in zip(ids, vectors)], SCHEMA)


def brute(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    keep = ids != ids[query]
    order = np.lexsort((ids[keep], -scores[keep]))[:k]
    return list(zip(ids[keep][order], scores[keep][order]))


@pytest.mark.parametrize("scale", [1.0, None])
def test_recall(spark, scale, monkeypatch):
    monkeypatch.setattr(forest, "QUERY_BYTES", 64 * 8 * 16)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if scale is None:
        vectors *= rng.uniform(0.2, 5, (1500, 1)).astype(np.float32)
    vectors[700:1000] = vectors[5]  # a hot vector
    ids = np.arange(1500) * 2
    out = forest.nearest(table(spark, ids.tolist(), vectors), F.col("vec_id") % 20 == 0, 20).collect()
    exact = vectors.astype(np.float64)
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 10):
        rows = sorted(got.pop(ids[q]))
        want = brute(ids, exact, q, 20)
        assert [r[0] for r in rows] == list(range(1, 21))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        for _, v, s in rows:
            assert s == (exact[v // 2] * exact[q]).sum()
        edge = want[-1][1]
        hits += sum(s >= edge for _, _, s in rows)
    assert not got and hits >= 0.9 * 150 * 20


def test_equal_vectors_are_ranked_by_id(spark):
    out = forest.nearest(table(spark, range(60), [[1.0, 2.0, 3.0]] * 60), F.col("vec_id") == 40, 5).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(i + 1, i, 14.0) for i in range(5)]


def test_unusable_vectors(spark):
    vectors = [[1, 0], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [], [0.5, 0.5], [2, 2, 2], [1, 1]]
    out = forest.nearest(table(spark, [*range(8), 8, None], vectors), F.lit(True), 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(0, 1, 7, 0.5), (7, 1, 0, 0.5)]
    assert forest.nearest(table(spark, [], []), F.lit(True), 20).collect() == []
    twice = forest.nearest(table(spark, [1, 1, 2], [[1, 0], [0, 1], [3, 0]]), F.col("vec_id") == 2, 20).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in twice) == [(1, 1, 3.0), (2, 1, 0.0)]


def test_ascending_gathers_prefixes():
    """Candidates are the rows that share the longest prefix length at which enough do in some tree."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 8))
    built = forest.Forest(vectors, float(np.linalg.norm(vectors, axis=1).max()), trees=6, length=12)
    queries = rng.standard_normal((10, 8))
    strings = np.empty((6, 300), np.uint64)
    np.put_along_axis(strings, built.order, built.sorted, axis=1)
    asked = built.strings(np.column_stack([queries, np.zeros(10)]))
    for q, found in enumerate(built.candidates(queries, 40)):
        shared = np.array([[12 - int(int(a) ^ int(b)).bit_length() for b in strings[t]] for t, a in enumerate(asked[:, q])]).max(axis=0)
        level = max(x for x in range(13) if (shared >= x).sum() >= 40)
        assert found.tolist() == np.flatnonzero(shared >= level).tolist()
