import random

import pytest

from millrace.llm import packing
from tests.llm.common import frame


def plain_best_fit(lengths, width):
    room = []
    for size in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= size]
        best = min(fits) if fits else width
        if fits:
            room.remove(best)
        room.append(best - size)
    return sorted(room)


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(400):
        width = rng.choice([1, 2, 7, 8, 9, 31, 64, 100])
        lengths = [rng.randint(1, width) for _ in range(rng.randrange(60))]
        rows = packing.best_fit_decreasing(lengths, width)
        assert sorted(s for r in rows for s in r) == list(range(len(lengths)))
        assert sorted(width - sum(lengths[s] for s in r) for r in rows) == plain_best_fit(lengths, width)


@pytest.mark.parametrize("window", [1 << 20, 500])
def test_lossless(spark, monkeypatch, window):
    monkeypatch.setattr(packing, "WINDOW", window)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["word ", "é😀", "\n\n", "  x", "<|endoftext|>", "7"]) for _ in range(rng.choice([1, 5, 90]))), "s") for i in range(80)]
    rows += [(500, "a long one " * 4000, "s"), (501, None, "s"), (502, "", "s"), (503, " ", None)]
    packed = packing.pack(frame(spark, rows), width=128).cache()
    tokens, rows_seen = {}, set()
    for r in packed.collect():
        assert len(r.ids) == 4 * 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used <= 128
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.doc_offsets) == len(r.position_resets)
        assert sorted(r.cu_seqlens) == r.cu_seqlens and (r.part, r.row) not in rows_seen
        rows_seen.add((r.part, r.row))
        positions = packing.position_ids(r.cu_seqlens, 128)
        assert all(positions[p] == 0 for p in r.position_resets) and positions[r.used - 1] == r.used - 1 - r.position_resets[-1]
    for r in sorted(packing.unpack(packed).collect(), key=lambda r: (r.doc_id, r.offset)):
        assert len(tokens.setdefault(r.doc_id, [])) == r.offset
        tokens[r.doc_id] += r.ids
    decode = packing.tokenizer(packing.RANKS).decode
    assert {d: decode(t) for d, t in tokens.items()} == {d: t for d, t, _ in rows if t}
    packed.unpersist()


def test_repeated_and_empty(spark):
    assert packing.pack(frame(spark, [])).collect() == []
    out = packing.pack(frame(spark, [(1, "same", "s"), (1, "same", "s"), (None, "same", "s")]).coalesce(1)).collect()
    assert len(out) == 1 and sorted(out[0].doc_ids, key=str) == [1, 1, None]


def test_write(spark, tmp_path):
    packing.write(packing.pack(frame(spark, [(1, "some text", "s")])), str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1
