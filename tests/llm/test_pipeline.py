import random
from collections import Counter

import corpus_pipeline as pipeline
from millrace.bindings.base import Tables
from millrace.llm import pieces
from tests.llm.common import WORD, components, frame

SF = "/root/testdata/sf0.01"


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_stages_against_brute_force(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "mix", "encode"]
    docs = Tables(spark, SF).documents
    good = pipeline.good_quality(spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    wrong = [d for d, q in labels.items() if (d in ids) != bool(q)]
    assert good.columns == docs.columns and len(wrong) <= 0.01 * len(labels)

    before = rows(good)
    apart = pipeline.near_dedup(spark, good, SF).cache()
    want = components([(d, t) for d, t, _ in before], 80)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == sorted(set(want.values()))

    mixed = pipeline.mix(spark, apart, SF).cache()
    assert mixed.columns == docs.columns
    sizes = Counter()
    for _, text, source in rows(apart):
        sizes[source] += len(WORD.findall(text))
    taken = Counter()
    for _, text, source in rows(mixed):
        taken[source] += len(WORD.findall(text))
    total, order = sum(sizes.values()), sorted(sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    for s in order:  # no limit is reached here
        target = total * weight[s] / sum(weight.values())
        assert target <= 3 * sizes[s] and abs(taken[s] - target) <= 0.01 * target
    assert max(Counter(r[0] for r in rows(mixed)).values()) <= 3

    final = pipeline.encode(spark, mixed, SF).collect()
    decode = pieces.load(pieces.MODEL).decode
    assert Counter(r.doc_id for r in final) == Counter(r[0] for r in rows(mixed))
    assert all(r.lossless and decode(r.ids).decode() == r.text for r in random.Random(1).sample(final, 100))


def test_stages_take_odd_rows(spark):
    odd = [(None, "no id", None), (None, None, None), (1, None, "s"), (2, "", "s"), (3, "w " * 30_000, "s"), (3, "w " * 30_000, "s"), (4, "other text", None)]
    docs = frame(spark, odd).selectExpr("*", "1 as n", "2 as class", "3 as copies", "4 as score")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(out.columns) >= set(pipeline.COLUMNS), name
        out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
