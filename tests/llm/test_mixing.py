import random

import pytest

from millrace.llm import mixing
from millrace.llm.words import word_count
from tests.llm.common import WORD, frame


def wanted(sizes, weights, most=3):
    """Targets by water filling, one limit at a time."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(order), {}
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
        free -= set(over)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    names = ["b", "a", "Z", "é", "tiny", None]
    out = [(i, " ".join("x" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(1.1) * 8))), rng.choices(names, [40, 20, 20, 10, 1, 9])[0]) for i in range(900)]
    return out + [(9000, None, "a"), (9001, "", "empty"), (None, "w " * 30, "b"), (7, out[7][1], out[7][2])]


def test_mix(spark, rows):
    out = mixing.mix(frame(spark, rows), (1, 2, 3), word_count("text")).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5), (1, 2, 3), word_count("text")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == len(rows)
    texts, sizes = {}, {}
    for d, t, s in rows:
        texts[d] = t
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = wanted(sizes, (1, 2, 3))
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s, total in taken.items():
        assert abs(total - want[s]) <= max(8, 0.005 * want[s]), (s, total, want[s])


def test_repeat_moves_whole_rows(spark, rows):
    df = frame(spark, rows)
    out = mixing.repeat(df, (1, 2, 3), word_count("text"))
    assert out.columns == df.columns
    assert set(map(str, out.collect())) <= set(map(str, df.collect()))


def test_longer_documents_are_likelier(spark):
    rows = [(i, "w " * (4 if i % 2 else 256), "a") for i in range(2000)] + [(5000 + i, "w " * 10, "b") for i in range(26)]
    out = mixing.mix(frame(spark, rows), (1, 1), word_count("text"), seed=3).filter("source = 'a'").collect()
    share = [sum(r.copies for r in out if (r.size == 256) == big) / 1000 for big in (False, True)]
    assert out[0].target < out[0].source_size and share[1] > share[0]


def test_empty_and_single(spark):
    assert mixing.mix(frame(spark, []), (1, 2, 3), word_count("text")).collect() == []
    one = mixing.mix(frame(spark, [(1, "a b c", None)]), (1, 2, 3), word_count("text")).collect()
    assert [(r.size, r.target, r.copies) for r in one] == [(3, 3.0, 1)]
    none = mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")]), (1,), word_count("text")).collect()
    assert [(r.target, r.copies) for r in none] == [(0.0, 0)] * 2


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    """Equal sizes and no ids: the target is met by some of them, not by all or none."""
    from millrace.llm.queries import mix_sources

    class Tables:
        documents = frame(spark, [(None, " ".join(f"w{i}x{j}" for j in range(9)), "a") for i in range(400)] + [(i, "w " * 9, "b") for i in range(400)])

    out = mix_sources(Tables()).collect()
    taken = {s: sum(r.taken for r in out if r.source == s) for s in "ab"}
    target = {r.source: r.target for r in out}
    assert all(abs(taken[s] - target[s]) <= 9 for s in "ab")
