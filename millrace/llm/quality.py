"""Quality scores by co-training two views of a document: its text, and its metadata.

Each view has a logistic model.  Both are fitted to the labelled documents; then, round after round, the documents that
one view is sure about are given to the other view as labelled ones.  Labels that training never sees calibrate both
views and the weights with which they are combined.

Models are fitted by Newton steps whose sums run over all rows: a task reduces its rows to one gradient and one Hessian
per view, Spark adds these up by entry, and only the sums (a few thousand numbers, whatever the input) reach the driver.
Texts are read once, for their features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import append_columns, as_input, split_words, whole, word_hashes
from millrace.session import written

#: Bytes by kind; each kind's share of a text is a feature.  The last kind is everything that is not ASCII.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"-()", b"!", b"|", b"#$%&*", b"<>{}[]=/\\@_~^+`"]
HASHED_WORDS, HASHED_SOURCES, HASHED_LANGS = 32, 32, 8
#: A pseudo-label needs at least this probability of its class.
CONFIDENT = 0.98
ROUNDS, STEPS = 2, 4
#: One labelled document in so many is kept from training and calibrates.
HOLDOUT = 5
#: Text bytes whose features are computed at once; each takes about 15 bytes of memory meanwhile.
TEXT_BYTES = 1 << 20
RIDGE = 1e-3


def text_features(texts: pa.Array) -> np.ndarray:
    """One row per text: shares of byte kinds, shape of words and lines, repetition, hashed words.  Null is empty."""
    texts, raw, sizes = whole(texts)
    n, raw = len(texts), np.frombuffer(raw, np.uint8)
    kind = np.full(256, len(KINDS), np.int64)
    for k, members in enumerate(KINDS):
        kind[list(members)] = k
    kind[:128][kind[:128] == len(KINDS)] = len(KINDS) - 1
    width = len(KINDS) + 1
    counts = np.bincount(np.repeat(np.arange(n) * width, sizes) + kind[raw], minlength=n * width).reshape(n, width)
    codes, words, bounds = split_words(texts)
    per = np.diff(bounds)
    of = np.repeat(np.arange(n), per)
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.float64) if len(words) else np.empty(0)
    hashes = word_hashes(words, 3)
    bucket, sign = (hashes % np.uint64(HASHED_WORDS)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)
    distinct = np.bincount(np.unique(of * max(1, len(words)) + codes) // max(1, len(words)), minlength=n) if len(codes) else np.zeros(n)
    again = np.bincount(of[1:][(codes[1:] == codes[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(codes) else np.zeros(n)
    hashed = np.bincount(of * HASHED_WORDS + bucket[codes], weights=sign[codes], minlength=n * HASHED_WORDS).reshape(n, HASHED_WORDS)
    total, some = np.maximum(sizes, 1)[:, None], np.maximum(per, 1)
    shape = [
        np.bincount(of, weights=length[codes], minlength=n) / some / 10,
        np.bincount(of, weights=(length[codes] > 20).astype(float), minlength=n) / some,
        distinct / some,
        again / some,
        np.log1p(per) / 10,
        np.log1p(counts[:, 4]) / 10,
        per == 0,
    ]
    return np.column_stack([np.ones(n), counts / total, np.sqrt(counts / total), *shape, hashed / np.sqrt(some)[:, None]]).astype(np.float32)


def meta_features(source: list, lang: list, chars: np.ndarray) -> np.ndarray:
    """One row per document: hashed source and language, size as the table states it.  Nulls are values of their own."""
    n = len(source)
    out = np.zeros((n, 4 + HASHED_SOURCES + HASHED_LANGS), np.float32)
    out[:, 0] = 1
    known = ~np.isnan(chars)
    size = np.log1p(np.maximum(np.where(known, chars, 0), 0)) / 10
    out[:, 1], out[:, 2], out[:, 3] = size, size**2, ~known
    for values, at, width in ((source, 4, HASHED_SOURCES), (lang, 4 + HASHED_SOURCES, HASHED_LANGS)):
        out[np.arange(n), [at + xxhash.xxh3_64_intdigest("" if v is None else f"={v}") % width for v in values]] = 1
    return out


def _inputs(df: DataFrame, text: str, source: str, lang: str, chars: str) -> dict:
    kinds = {"text": (text, "string"), "source": (source, "string"), "lang": (lang, "string"), "n_chars": (chars, "double")}
    return {name: as_input(df, column, kind) for name, (column, kind) in kinds.items()}


def _both(batch: pa.RecordBatch) -> list[np.ndarray]:
    chars = batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    return [text_features(batch.column("text")), meta_features(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), chars)]


def features(df: DataFrame, id: str, inputs: dict) -> DataFrame:
    """(id, t, m): the features of both views; one pass over the texts."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel()) for v in _both(batch)]

    rows = df.select(F.col(id).cast("long").alias("id"), *[(F.col(e) if isinstance(e, str) else e).alias(f"x_{n}") for n, e in inputs.items()])
    return append_columns(rows, {n: f"x_{n}" for n in inputs}, {"t": "array<float>", "m": "array<float>"}, lambda: work, by="text", limit=TEXT_BYTES, keep=["id"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _newton_sums(rows: DataFrame, prepare, sizes: list[int], weights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian of the log-likelihood of each model, summed over all rows.

    ``prepare(batch)`` gives (x, y) of each model, y being nan where a row does not take part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((d + 1, d)) for d in sizes]
        for batch in batches:
            if batch.num_rows:
                for (x, y), w, total in zip(prepare(batch), weights, sums):
                    x, y = x[~np.isnan(y)], y[~np.isnan(y)]
                    p = _sigmoid(x @ w)
                    total[0] += x.T @ (y - p)
                    total[1:] += (x * (p * (1 - p))[:, None]).T @ x
        flat = np.concatenate([s.ravel() for s in sums])
        if flat.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    found = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(sum((d + 1) * d for d in sizes))
    flat[found["k"].to_numpy()] = found["v"].to_numpy()
    out = []
    for d in sizes:
        part, flat = flat[: (d + 1) * d].reshape(d + 1, d), flat[(d + 1) * d :]
        out.append((part[0], part[1:]))
    return out


def _fit(rows: DataFrame, prepare, weights: list[np.ndarray], steps: int = STEPS) -> list[np.ndarray]:
    for _ in range(steps):
        sums = _newton_sums(rows, prepare, [len(w) for w in weights], weights)
        weights = [_step(w, g, h) for w, (g, h) in zip(weights, sums)]
    return weights


def _step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    ridge = RIDGE * (1 + np.trace(hessian) / len(w))
    step = np.linalg.solve(hessian + ridge * np.eye(len(w)), gradient - ridge * w)
    return np.round(w + step * min(1.0, 8.0 / max(np.abs(step).max(), 1e-12)), 9)


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_matrix(batch.column("t")), _matrix(batch.column("m"))]


def _labels(batch: pa.RecordBatch, fold: int) -> np.ndarray:
    y = batch.column("y").cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(batch.column("fold").to_numpy(zero_copy_only=False) == fold, y, np.nan)


@dataclass
class Model:
    """Weights of both views, and of their calibration: text alone, metadata alone, both together."""

    views: list[np.ndarray]
    calibrated: list[np.ndarray]

    def inputs(self, views: list[np.ndarray]) -> list[np.ndarray]:
        logits = [np.clip(x.astype(np.float64) @ w, -30, 30) for x, w in zip(views, self.views)]
        one = np.ones(len(logits[0]))
        return [np.column_stack([one, logits[0]]), np.column_stack([one, logits[1]]), np.column_stack([one, *logits])]

    def scores(self, views: list[np.ndarray]) -> list[pa.Array]:
        p = [_sigmoid(x @ w) for x, w in zip(self.inputs(views), self.calibrated)]
        return [*map(pa.array, p), pa.array(p[2] >= 0.5)]


NEW = {"text_score": "double", "meta_score": "double", "score": "double", "kept": "boolean"}


def train(data: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> tuple[DataFrame, Model | None]:
    """Co-train on ``features`` rows: the rows with their labels, and the model (None if a class has no label)."""
    votes = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("double").alias("y")).dropna().groupBy("id").agg(F.avg("y").alias("y"))
    votes = votes.filter("y != 0.5").select("id", (F.col("y") > 0.5).cast("double").alias("y"))
    held = F.when(F.pmod(F.xxhash64("id"), F.lit(HOLDOUT)) == 0, 1).otherwise(0)
    known, unknown = data.filter("id is not null"), data.filter("id is null").withColumn("y", F.lit(None).cast("double"))
    data = written(known.join(votes, "id", "left").select("id", "t", "m", "y").union(unknown).withColumn("fold", held))
    seen = data.filter("y is not null").groupBy("y", "fold").agg(F.count("*")).collect()
    if len(seen) < 4:  # both classes, in training and for calibration
        return data, None

    def labelled(batch: pa.RecordBatch):
        y = _labels(batch, 0)
        return [(x, y) for x in _views(batch)]

    start = [np.zeros(text_features(pa.array([""])).shape[1]), np.zeros(4 + HASHED_SOURCES + HASHED_LANGS)]
    models = _fit(data, labelled, start)
    for _ in range(ROUNDS):

        def exchanged(batch: pa.RecordBatch, models=models):
            views, y = _views(batch), _labels(batch, 0)
            known = ~np.isnan(y) | ~np.isnan(_labels(batch, 1))
            sure = []
            for x, w in zip(views, models):
                p = _sigmoid(x @ w)
                sure.append(np.where(known, y, np.where(p >= CONFIDENT, 1.0, np.where(p <= 1 - CONFIDENT, 0.0, np.nan))))
            return [(views[0], sure[1]), (views[1], sure[0])]

        models = _fit(data, exchanged, models, STEPS - 1)
    model = Model(models, [])

    def calibration(batch: pa.RecordBatch):
        y = _labels(batch, 1)
        return [(x, y) for x in model.inputs(_views(batch))]

    model.calibrated = _fit(data, calibration, [np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([0.0, 1.0, 0.0])])
    return data, model


def _unscored(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in NEW.items()}).withColumn("kept", F.lit(True))


def score(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", chars: str = "n_chars", label: str = "quality") -> DataFrame:
    """``df`` with ``text_score``, ``meta_score``, ``score`` (calibrated probabilities of good quality) and ``kept``.

    ``labels`` has the columns ``id`` and ``label`` (0 or 1); several labels of one document count by majority, a draw
    or a null not at all.  Documents without a label, null ids among them, take part as unlabelled ones.  Null and
    empty texts are scored like any other (as texts without words).  ``kept`` means ``score >= 0.5``.  If one of the
    classes has no label (in training or for calibration), nothing can be learnt: scores are null and everything is
    kept.  Columns of ``df`` named like the new ones are replaced, all others stay; repeated rows stay repeated; an
    empty table gives an empty result.  Texts are read twice, and rows are not moved.
    """
    inputs = _inputs(df, text, source, lang, chars)
    _, model = train(written(features(df, id, inputs)), labels, id, label)
    if model is None:
        return _unscored(df)
    return append_columns(df, inputs, NEW, lambda: lambda batch: model.scores(_both(batch)), by="text", limit=TEXT_BYTES)


def document_scores(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", chars: str = "n_chars", label: str = "quality") -> DataFrame:
    """(id, text_score, meta_score, score, kept) only: as ``score``, but texts are read once."""
    data, model = train(written(features(df, id, _inputs(df, text, source, lang, chars))), labels, id, label)
    data = data.withColumnRenamed("id", id)
    if model is None:
        return _unscored(data.select(id))
    return append_columns(data, {"t": F.col("t"), "m": F.col("m")}, NEW, lambda: lambda batch: model.scores(_views(batch))).select(id, *NEW)
