import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from millrace.llm import ordermin
from tests.llm.common import WORD, frame

PLACE = (1 << ordermin.PLACE_BITS) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_long(x, seed=42):
    return xxhash.xxh64_intdigest(struct.pack("<q", x), seed)


def signature(text):
    """Straight from the definition, one k-mer after another."""
    words = WORD.findall(text)
    if not words:
        return [None] * ordermin.SLOTS
    if len(words) < 2:
        found = [signed(xxhash.xxh64_intdigest(words[0].encode(), 42))]
    else:
        found = [signed(xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))) for a, b in zip(words, words[1:])]
    seen, slots = {}, {}
    for place, x in enumerate(found):
        high = x >> ordermin.PLACE_BITS
        seen[high] = seen.get(high, -1) + 1
        packed = signed(xxhash.xxh64_intdigest(struct.pack("<i", seen[high]), hash_long(high))) >> ordermin.PLACE_BITS << ordermin.PLACE_BITS | place
        slots.setdefault((packed >> 58) + 32, []).append(packed)
    out = [None] * ordermin.SLOTS
    for slot, items in slots.items():
        value = 42
        for place in sorted(x & PLACE for x in sorted(items)[: ordermin.KEEP]):
            value = hash_long(found[place], value)
        out[slot] = signed(value)
    return out


def likeness(a, b):
    either = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    return 1.0 if not either else sum(x == y for x, y in either) / len(either)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i * 2, " ".join(rng.choice(["a", "bé", "c", "the", "x😀"]) + str(rng.randrange(9)) for _ in range(rng.choice([1, 2, 5, 60, 400]))), "s") for i in range(60)]
    rows += [(500, None, "s"), (501, "", "s"), (502, " \n\t", "s"), (503, "one", "s"), (504, "ab" * 20000, "s"), (505, "the cat " * 9000, "s"), (None, "last of all", None)]
    out = ordermin.edited_fingerprints(frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    after = {r[0]: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    texts = {d: t or "" for d, t, _ in rows}
    assert len(out) == len(rows)
    for r in out:
        text, follower = texts[r.doc_id], after[r.doc_id][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + follower[:third]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert (r.signature, r.edited_signature) == (signature(text), signature(edited))
        assert abs(r.near_edited - likeness(signature(text), signature(edited))) < 1e-12
        assert abs(r.near_next - likeness(signature(text), signature(follower))) < 1e-12


def test_ranges_agree(spark):
    """The successor does not depend on how ids are cut into ranges, repeated ids and rows among them."""
    rows = [(i // 3, f"text {i % 7}", "s") for i in range(200)] + [(5, "text 1", "s")] * 3
    results = []
    for parts in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        marked = ordermin.with_next(frame(spark, rows).select(F.col("doc_id").alias("num"), "text"), {"after": F.col("text")}, id="num")
        results.append(sorted(map(tuple, marked.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)


def test_fingerprints_follow_order_and_edits(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    swapped = words[300:] + words[:300]
    few = list(words)
    for i in rng.sample(range(600), 6):
        few[i] = "changed"
    rng.shuffle(shuffled := list(words))
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(few)), (2, " ".join(swapped)), (3, " ".join(shuffled))], "n int, text string")
    s = {r.n: r.s for r in df.select("n", ordermin.signature(F.col("text")).alias("s")).collect()}
    assert likeness(s[0], s[1]) > 0.8 > likeness(s[0], s[2]) > likeness(s[0], s[3])
    text = df.select(ordermin.fingerprint(ordermin.signature(F.col("text"))).alias("f")).collect()
    assert len({r.f for r in text}) == 4 and all(len(r.f) == ordermin.SLOTS * ordermin.SLOT_DIGITS for r in text)


def test_empty_and_alone(spark):
    assert ordermin.edited_fingerprints(frame(spark, [])).collect() == []
    one = ordermin.edited_fingerprints(frame(spark, [(1, "abcdef", "s")])).first()
    assert one.edited == "abcdab" and one.near_next == 1.0
    assert hashlib.sha256(one.edited.encode()).hexdigest()
