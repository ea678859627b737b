import random

import numpy as np
import pytest

from millrace.llm import ngramjoin
from tests.llm.common import components, frame, shingles


def changed(rng, words, places):
    words = list(words)
    for i in places:
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def texts(seed):
    """Groups of edited copies around the threshold, copies of copies, chains, shared passages, odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for _ in range(10):
        base = [word() for _ in range(rng.choice([6, 12, 30, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(10):
            copy = changed(rng, base, rng.sample(range(len(base)), rng.randrange(0, max(2, len(base) // 20))))
            out.append(copy if rng.random() < 0.5 else copy.upper())
            out.append(changed(rng, copy.split(), rng.sample(range(len(base)), rng.randrange(0, 2))))
    hub = [word() for _ in range(140)]  # the hub itself does not occur, its copies differ from one another at the threshold
    out += [changed(rng, hub, rng.sample(range(140), rng.randrange(2, 7))) for _ in range(150)]
    walk = [word() for _ in range(100)]  # each text is linked with the next only
    for i in range(30):
        walk = walk[3:] + [word() for _ in range(3)]
        out.append(" ".join(walk))
    passage = [word() for _ in range(120)]  # most of a text, but not enough for a link
    for i in range(60):
        own = [word() for _ in range(rng.choice([12, 14, 16, 30]))]
        out.append(" ".join(own + passage) if i % 2 else " ".join(passage + own))
    out += ["same words here"] * 4 + ["Same  words\there ", "", "   ", "one", "one", "two words"]
    rng.shuffle(out)
    return [(i * 3 + 5, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed, percent", [(3, 80), (4, 90), (5, 80)])
def test_components(spark, seed, percent):
    rows = texts(seed)
    out = ngramjoin.similar_texts(frame(spark, [(d, t, "s") for d, t in rows]), percent).collect()
    want, known = components(rows, percent), dict(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {d: (len(shingles(known[d])), want[d]) for d, _ in rows}
    assert len(out) == len(rows) and len(set(want.values())) < len(rows)


def test_other_pairs_are_needed_and_few(spark, monkeypatch):
    """Links that no leader has are found, without all pairs of a group."""
    tested = []
    linked = ngramjoin._Join.linked

    def spy(self, pairs):
        tested.append(pairs.count())
        return linked(self, pairs)

    monkeypatch.setattr(ngramjoin._Join, "linked", spy)
    rng = random.Random(8)
    hub = [f"h{i}" for i in range(160)]
    rows = [(i, changed(rng, hub, rng.sample(range(160), rng.choice([2, 3, 4, 5, 6])))) for i in range(400)]
    twin = changed(rng, hub, rng.sample(range(160), 12)).split()
    rows += [(1000 + i, changed(rng, twin, [i * 11])) for i in range(6)]
    out = {r.doc_id: r.component_id for r in ngramjoin.similar_texts(frame(spark, [(d, t, "s") for d, t in rows])).collect()}
    assert out == components(rows, 80)
    assert out[1005] == 1000 and tested[1] > 0
    assert sum(tested) < 20 * len(rows) < len(rows) ** 2 / 8


def test_odd_inputs(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None, "s"), (2, "", None), (3, " \t\n", "s"), (4, long, "s"), (5, long + " end", "s"), (6, "É é", "s"), (7, "é é", "s"), (None, long, "s"), (8, "a b", "s"), (4, long, "s"), (4, "A B", "s")]
    rows += [(None, "only without ids", "s"), (None, "only Without ids", "s"), (9, "x " * 50_000, "s"), (10, "X " * 60_000, "s")]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.similar_texts(frame(spark, rows)).collect()), key=str)
    n = 29_996
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (4, n, 4), (5, n + 1, 4), (None, n, 4), (6, 1, 6), (7, 1, 7), (8, 1, 4), (4, 1, 4), (None, 1, None), (None, 1, None), (9, 1, 9), (10, 1, 9)]
    assert out == sorted(want, key=str)
    assert ngramjoin.similar_texts(frame(spark, [])).collect() == []


def test_leaders_in_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "PAIRS_TOGETHER", 3)
    rows = texts(6)[:150]
    out = ngramjoin.similar_texts(frame(spark, [(d, t, "s") for d, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in out} == components(rows, 80)


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(2)
    pruned = 0
    for _ in range(300):
        n = int(rng.integers(1, 900))
        x = rng.choice(2**62, n, replace=False) - 2**61
        keep = int(n * rng.random())
        y = np.concatenate([x[:keep], rng.choice(2**62, int(rng.integers(0, n)), replace=False) - 2**61])
        bound = ngramjoin.least_difference(ngramjoin.pivot_counts(x, n), ngramjoin.pivot_counts(y, max(1, len(y))))
        assert bound <= len(np.setxor1d(x, y))
        pruned += 9 * bound > len(x) + len(y)
    assert pruned > 100
