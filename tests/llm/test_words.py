import random
import re
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from millrace.llm import pieces, pseudolm, quality
from millrace.llm.words import CHUNK_BYTES, append_columns, as_input
from tests.llm.common import frame


def sent(df):
    """Columns that Arrow tasks get and give back, by the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    (back,) = re.findall(r"MapInArrow run\(([^)]*)\)[^\[]*\[([^\]]*)\]", plan)
    return [[re.sub(r"#.*", "", c.strip()) for c in part.split(",")] for part in back]


def test_a_text_is_sent_once_and_returned_only_if_kept(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, None, None)])
    inputs = quality._inputs(docs, "text", "source", "lang", "n_chars")
    assert sent(quality.features(docs, "doc_id", inputs)) == [["c0", "i_text", "i_source", "i_lang", "i_n_chars"], ["c0", "n0", "n1"]]
    assert "i_text" not in sent(pieces.encode(docs, key=["doc_id"]))[0]
    vocabulary = pseudolm.frequent_words(docs)
    assert sent(pseudolm.encode(docs, vocabulary)) == [["c0", "i_text"], ["c0", "n0", "n1", "n2"]]
    assert sent(pseudolm.score(docs))[1] == ["c0", "c1", "n0"]


def test_inputs_by_name_or_expression_give_the_same(spark):
    docs = frame(spark, [(1, "a b", "s"), (2, None, None), (3, "é", "t")])
    odd = docs.withColumnRenamed("text", "a.b").withColumnRenamed("row", "Row x")

    def sizes(df, column, keep=None, by=None):
        make = lambda: lambda batch: [pc.binary_length(batch.column("x")).cast(pa.int64())]
        return append_columns(df, {"x": column}, {"size": "long"}, make, by=by, keep=keep)

    whole = sizes(docs, as_input(docs, "text", "string"), by="x")
    assert as_input(docs, "text", "string") == "text" and whole.columns == [*docs.columns, "size"]
    assert whole.collect() == sizes(docs, F.col("text")).collect()
    assert sorted(map(tuple, sizes(docs, "text", keep=["doc_id"], by="x").collect()), key=str) == [(1, 3), (2, None), (3, 2)]
    assert not isinstance(as_input(docs, "n_chars", "string"), str) and not isinstance(as_input(odd, "a.b", "string"), str)
    assert [r["size"] for r in sizes(odd, F.col("`a.b`"), keep=["Row x"]).collect()] == [r["size"] for r in whole.collect()]
    assert sizes(docs.withColumn("size", F.lit("z")), "size", keep=[]).distinct().collect()[0] == (1,)


def test_a_task_holds_little_beside_its_texts(spark, monkeypatch):
    """Peak memory of what is worked on at once, for features and pieces: workers keep it, beside the JVM, to their end."""
    limits = []
    monkeypatch.setattr(quality, "append_columns", lambda *a, **k: limits.append(k.get("limit")) or append_columns(*a, **k))
    docs, rng = frame(spark, [(1, "a b", "s")]), random.Random(1)
    quality.features(docs, "doc_id", quality._inputs(docs, "text", "source", "lang", "n_chars"))
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(20_000)]
    encoder = pieces.Encoder(pieces.load(pieces.MODEL), 0.1, 1)
    for limit, work in ((limits[0] or CHUNK_BYTES, lambda x: quality.text_features(pa.array(x))), (pieces.TEXT_BYTES, encoder.encode)):
        texts = [" ".join(rng.choices(words, k=400)) for _ in range(limit // 2600)]
        tracemalloc.start()
        work(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50 << 20
