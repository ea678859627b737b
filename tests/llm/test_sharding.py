import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import sharding
from tests.llm.common import frame


def check(spark, rows, shards):
    out = sharding.shard(frame(spark, rows), shards, carry=("text", "key")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((d, t) for d, t, _ in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.key) == (len(raw) + 16, zlib.crc32(raw), "y")
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return out, [sizes[s] for s in range(shards)]


def test_sizes_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), "é" * rng.randrange(200), "s") for _ in range(3000)]
    rows += [(i, "one text that is a third of all rows", "s") for i in range(1500)] + [(7, "the very same row", None)] * 400
    rows += [(None, None, "s"), (None, "", "s"), (3, "z" * 3000, "s")]
    out, sizes = check(spark, rows, 7)
    fair, longest = sum(sizes) / 7, 3016
    assert max(sizes) - min(sizes) <= 2 * (longest + 0.002 * fair)
    near = sorted(sizes)
    assert near[-2] - near[1] <= 2 * (416 + 0.002 * fair)
    shards_of = defaultdict(set)
    for r in out:
        shards_of[r.text].add(r.shard)
    for found in shards_of.values():  # equal texts are neighbours
        assert max(found) - min(found) + 1 == len(found)


@pytest.mark.parametrize("count", [0, 1, 3])
def test_few_rows(spark, count):
    check(spark, [(i, "t" * i, "s") for i in range(count)], 40)


def test_blocks_number_slots_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BYTES", 500)
    check(spark, [(i, "t" * (i % 50), "s") for i in range(600)], 3)
