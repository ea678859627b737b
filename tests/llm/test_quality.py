import random

import numpy as np
import pyarrow as pa

from millrace.llm import quality
from millrace.llm.words import split_words
from tests.llm.common import frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    hidden = set(random.Random(1).sample(sorted(known), 120))
    given = labels.filter(~labels.doc_id.isin(sorted(hidden)))
    out = quality.document_scores(docs, given).collect()
    assert len(out) == docs.count()
    right = [r.kept == bool(known[r.doc_id]) for r in out if r.doc_id in hidden]
    assert np.mean(right) >= 0.97
    good = [r.kept for r in out if known.get(r.doc_id) == 1]
    assert np.mean(good) >= 0.99  # clean documents are left alone
    assert all(0 <= r.score <= 1 for r in out)


def test_rows_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    odd = frame(spark, [(None, "no id", None), (800001, None, None), (800002, "", "s"), (800003, "word " * 60_000, "s"), (800002, "", "s")])
    both = docs.unionByName(odd.drop("id", "row", "key")).selectExpr("*", "'mine' as score", "1 as row", "2 as c0", "3 as text_score")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "quality")
    mixed = labels.unionByName(spark.createDataFrame([(None, 1), (800001, None), (800002, 0), (800002, 1)], "doc_id long, quality int"))
    out = quality.score(both, mixed)
    assert set(out.columns) == {*docs.columns, "row", "c0", "text_score", "meta_score", "score", "kept"}
    rows = out.collect()
    assert len(rows) == 305 and all(r.kept in (True, False) and r.row == 1 and r.c0 == 2 for r in rows)
    agree = {r.doc_id: r.score for r in quality.document_scores(both, mixed).collect() if r.doc_id is not None}
    assert all(abs(agree[r.doc_id] - r.score) < 1e-5 for r in rows if r.doc_id is not None)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(frame(spark, [(1, "a", "s"), (2, None, None)]), none).collect()
    assert [r.kept for r in out] == [True, True] and out[0].score is None
    assert quality.score(frame(spark, []), none).collect() == []
    assert quality.document_scores(frame(spark, []), none).collect() == []


def test_words_of_slices():
    """Words are those of the text, in whole arrays and in slices of them."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "É", " ", "  ", "\n", "\t", "\x0b", "\x1c", " ", "😀"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts[7] = None
    for lower in (False, True):
        for start, stop in ((0, 500), (100, 350), (499, 500), (7, 8)):
            codes, words, bounds = split_words(pa.array(texts).slice(start, stop - start), lower)
            found = words.to_pylist()
            for text, a, b in zip(texts[start:stop], bounds[:-1], bounds[1:]):
                raw = (text or "").encode()
                assert [found[c].encode() for c in codes[a:b]] == (raw.lower() if lower else raw).split()


def test_views_are_separate():
    text = quality.text_features(pa.array(["SHOUT!! SHOUT!!", "quiet words, read once.", None, ""]))
    assert text.shape[0] == 4 and np.isfinite(text).all() and (text[2] == text[3]).all() and not (text[0] == text[1]).all()
    meta = quality.meta_features(["a", None, "a", "b"], ["en"] * 4, np.array([10.0, 10.0, np.nan, 10.0]))
    assert np.isfinite(meta).all() and not (meta[0] == meta[1]).all() and not (meta[0] == meta[2]).all()
