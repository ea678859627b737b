import random
from array import array

import numpy as np
import pytest
import sentencepiece

from millrace.llm import pieces
from tests.llm.common import frame

ODD = ["", " ", "  lead", "a  b   c\td\n\n", "x▁y ▁ z", "▁", "emoji 😀 \x00 z", "한국어 벨 ゼ", "a" * 3000, " " * 50 + "q", "İstanbul ﬁ", "<s> </s> <unk> <0x41>", "é", "﻿"]


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.MODEL)


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD


def test_plain_equals_the_library(model, texts):
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text, ids in zip(texts, pieces.Encoder(model, 0, 1, 1).encode(texts)):
        if "▁" not in text:
            assert np.frombuffer(ids, np.int32).tolist() == own.encode(text), text[:50]


def simple(model, text, key, limit):
    """Merging by definition: look through all pairs again after every step."""
    symbols = [(c, i, i + 1) for i, c in enumerate(text)]
    skipped = set()
    while True:
        pairs = [(model.rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a[0] + b[0] in model.rank and (a, b) not in skipped]
        if not pairs:
            return [i for s in symbols for i in model.characters(s[0])]
        _, i = min(pairs)
        a, b = symbols[i], symbols[i + 1]
        if limit and pieces.skips(key, a[1], b[2], limit):
            skipped.add((a, b))
        else:
            symbols[i : i + 2] = [(a[0] + b[0], a[1], b[2])]


@pytest.mark.parametrize("dropout", [0, 0.1, 0.5, 1])
def test_agenda_against_definition(model, texts, dropout):
    rng = random.Random(1)
    units = sorted({u for t in texts for u in model.units.findall(" " + t) if len(u) < 60})
    units = rng.sample(units, 1500) + ["▁", " ", "   ", "\n", "x" * 39, "x" * 40, "x" * 41]
    keys = np.random.default_rng(2).integers(0, 2**64, len(units), dtype=np.uint64)
    many = model.segment_many(units, keys, dropout)
    limit = int(dropout * (1 << 64))
    for unit, key, found in zip(units, keys.tolist(), many):
        assert found == array("i", model.segment(unit, key, dropout)).tobytes()
        if len(unit) > 1:
            assert np.frombuffer(found, np.int32).tolist() == simple(model, unit.replace(" ", "▁"), key, limit)


def test_lossless_and_varied(model, texts):
    results = []
    for seed in (1, 2):
        coded = pieces.Encoder(model, 0.2, seed, 4).encode(texts)
        assert coded == pieces.Encoder(model, 0.2, seed, 4).encode(texts)
        for text, ids in zip(texts, coded):
            assert model.decode(np.frombuffer(ids, np.int32).tolist()).decode() == text
        results.append(coded)
    assert sum(a != b for a, b in zip(*results)) > 0.9 * (len(texts) - len(ODD))
    # one word, several segmentations under one seed
    repeated = pieces.Encoder(model, 0.3, 1, 4)
    repeated.encode(["extraordinarily " * 2000])
    assert len({k[" extraordinarily"] for k in repeated.known}) > 1


def test_remembering_changes_nothing(model, texts, monkeypatch):
    want = pieces.Encoder(model, 0.1, 1, 4).encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    few = pieces.Encoder(model, 0.1, 1, 4)
    assert [few.encode([t])[0] for t in texts] == want


def test_tables(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "no id", None), (77, None, "s"), (0, "", "s")]
    df = frame(spark, rows).selectExpr("*", "'mine' as ids", "5 as c0", "6 as n0")
    out = pieces.decode(pieces.encode(df))
    assert set(out.columns) == {*df.columns, "n_tokens", "decoded"}
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.decoded == r.text and (r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) and (r.c0, r.n0, r.id) == (5, 6, "x")
    assert all(r.lossless for r in pieces.encode(df, verify="lossless").collect())
    assert pieces.encode(frame(spark, [])).collect() == []


def test_every_occurrence_is_drawn(model):
    """Occurrences of a word within one run differ, as do copies of a text; each follows from its own key alone."""
    word = "extraordinarily "
    one, two = pieces.Encoder(model, 0.3, 1).encode([word * 60] * 2, ["a", "b"])
    assert one != two and pieces.Encoder(model, 0.3, 1).encode([word * 60], ["b"]) == [two]
    words = model.decode(np.frombuffer(one, np.int32).tolist()).decode().split()
    starts, cuts = [], []
    for i in np.frombuffer(one, np.int32).tolist():
        piece = model.bytes[i].decode()
        if piece.startswith(" "):
            starts.append([])
        starts[-1].append(piece)
    cuts = {tuple(x) for x in starts if "".join(x) == " extraordinarily"}
    assert len(words) == 60 and len(cuts) > 8


def test_copies_are_drawn_apart(spark):
    import corpus_pipeline

    df = frame(spark, [(1, "several extraordinarily long documents " * 20, "s")] * 3)
    assert len({tuple(r.ids) for r in corpus_pipeline.encode(spark, df, "").collect()}) == 3


def test_units_met_once_are_segmented_once(model, texts, monkeypatch):
    """Only units that come back are remembered; pieces do not depend on it, nor on what is in the batch."""
    encoder = pieces.Encoder(model, 0.3, 1)
    seen = []
    known = model.segment_many
    monkeypatch.setattr(model, "segment_many", lambda units, *a: seen.extend(units) or known(units, *a))
    encoder.encode(["quixotic zebras jumping jumping"], ["a"])
    assert seen.count(" quixotic") == 1 and " quixotic" not in encoder.known[0] and " jumping" in encoder.known[0]
    encoder.encode(["quixotic"], ["b"])
    assert " quixotic" in encoder.known[0]
    keys = [str(i) for i in range(len(texts))]
    remembering = pieces.Encoder(model, 0.3, 1, 2).encode(texts, keys)
    assert pieces.Encoder(model, 0.3, 1).encode(texts, keys) == remembering
    assert [pieces.Encoder(model, 0.3, 1).encode([t], [k])[0] for t, k in zip(texts, keys)] == remembering


def test_pair_table_against_pieces(model):
    """Each pair of pieces whose union is a piece is found in the table, and no other."""
    rng = np.random.default_rng(5)
    some = rng.choice([i for i in model.ids.values()], 20_000)
    names = {i: p for p, i in model.ids.items()}
    joined = [(model.ids[p[:k]], model.ids[p[k:]]) for p in list(model.rank)[::7] for k in range(1, len(p)) if p[:k] in model.ids and p[k:] in model.ids]
    left, right = (np.array([*x, *y]) for x, y in zip(zip(*joined), (some[::2], some[1::2])))
    ranks, ids = model._ranks(left, right)
    for a, b, r, i in zip(left.tolist(), right.tolist(), ranks.tolist(), ids.tolist()):
        union = names[a] + names[b]
        assert r == model.rank.get(union, pieces.NEVER) and (union not in model.rank or i == model.ids[union])


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1])
def test_equal_skips_are_followed_together(model, texts, monkeypatch, dropout):
    """Occurrences that skip the same merges are segmented once, and get what each gets by itself."""
    many = [*texts, "extraordinarily incomprehensible " * 400, " ".join(texts[:20]), None]
    keys = [str(i) for i in range(len(many))]
    seen, known = [], model.segment_many
    monkeypatch.setattr(model, "segment_many", lambda units, *a: seen.extend(units) or known(units, *a))
    together = pieces.Encoder(model, dropout, 1).encode(many, keys)
    assert seen.count(" extraordinarily") < 200
    monkeypatch.setattr(pieces.Encoder, "_drawn", lambda self, units, codes, keys: ([None] * len(units), codes.copy(), np.arange(len(codes))))
    assert pieces.Encoder(model, dropout, 1).encode(many, keys) == together


def test_many_texts_are_decoded_at_once(model, texts):
    coded = [*pieces.Encoder(model, 0.2, 1).encode(texts), b""]
    bounds = np.cumsum([0, *[len(c) // 4 for c in coded]])
    found = model.decode_many(np.frombuffer(b"".join(coded), np.int32), bounds)
    assert found == [model.decode(np.frombuffer(c, np.int32).tolist()) for c in coded] == [*[t.encode() for t in texts], b""]
    assert model.decode_many(np.empty(0, np.int32), np.zeros(3, np.int64)) == [b"", b""]
