import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import neardup
from millrace.llm.components import components as connect
from tests.llm.common import components, frame, shingles


def edited(rng, words, changes):
    words = list(words)
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies, edited copies near the threshold, copies of copies, shared passages, odd texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    passage = " ".join(word() for _ in range(60))
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 80, 200]))]
        texts.append(" ".join(base))
        for _ in range(10):
            copy = edited(rng, base, rng.randrange(0, max(2, len(base) // 20)))
            texts.append(copy if rng.random() < 0.5 else copy.upper())
            texts.append(edited(rng, copy.split(), rng.randrange(0, 3)))
    hub = [word() for _ in range(140)]
    texts += [edited(rng, hub, rng.randrange(1, 9)) for _ in range(120)]
    texts += [" ".join(word() for _ in range(20)) + " " + passage + " " + " ".join(word() for _ in range(20)) for _ in range(40)]
    texts += ["same words here"] * 4 + ["Same  words\there ", "", "   ", "one", "one", "two words"]
    rng.shuffle(texts)
    return [(i * 3 + 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("percent", [85, 80])
def test_components(spark, corpus, percent):
    out = neardup.near_duplicates(frame(spark, [(d, t, "s") for d, t in corpus]), percent).collect()
    want = components(corpus, percent)
    texts = dict(corpus)
    assert len(out) == len(corpus)
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (len(shingles(texts[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_drop_keeps_one_row_of_each_group(spark, corpus):
    rows = [(d, t, "s") for d, t in corpus]
    unlike = (rows[1][0], "a text of its own under an id", None)
    extra = [(None, "no id at all", "s"), (None, "no id at all", "s"), (None, rows[2][1], "s"), (900001, None, "s"), rows[0], unlike, unlike]
    out = neardup.drop_near_duplicates(frame(spark, rows + extra)).collect()
    want = components(corpus, 80)
    kept = Counter((r.doc_id, r.text) for r in out)
    assert kept[None, "no id at all"] == 1 and kept[900001, None] == 1 and kept[unlike[:2]] == 1  # unlike texts stay, each once
    texts = dict(corpus)
    assert set(kept) - {(None, "no id at all"), (900001, None), unlike[:2]} == {(d, texts[d]) for d in want.values()}
    assert max(kept.values()) == 1
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "id", "row", "key"}


def test_unlike_texts_under_one_id_do_not_join_groups(spark):
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(5, " ".join(words), "s"), (5, " ".join(other), "s"), (7, " ".join(words) + " x", "s"), (8, " ".join(other) + " x", "s"), (9, " ".join(other) + " y", "s")]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert [r.component_id for r in found] == [5] * 5 and len({r.group for r in found}) == 2
    assert sorted(r.text for r in neardup.drop_near_duplicates(frame(spark, rows)).collect()) == sorted([rows[0][1], rows[1][1]])


def test_odd_inputs(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None, "s"), (2, "", None), (3, " \t\n", "s"), (4, long, "s"), (5, long + " end", "s"), (6, "É é", "s"), (7, "é é", "s"), (None, long, "s"), (8, "a b", "s"), (4, long, "s")]
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), 85).collect()}
    assert out[1, 0] == (1, True) and out[2, 0] == (2, True) and out[3, 0] == (3, True)
    assert out[4, 29_996] == (4, True) and out[5, 29_997] == (4, False)
    assert out[6, 1] == (6, True) and out[7, 1] == (7, True)  # only A-Z are lowered
    assert out[None, 29_996] == (4, False)
    assert neardup.near_duplicates(frame(spark, []), 85).collect() == []


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (0.8, 0.9, 0.95):
        other = np.concatenate([base[: int(1000 * share)], rng.integers(0, 2**63, 1000 - int(1000 * share)).astype(np.uint64)])
        exact = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        x, y = (neardup.odd_sketch(neardup.minhash(s, 1000), 4096) for s in (base, other))
        differing = sum(int(v).bit_count() for v in (x ^ y).tolist())
        assert abs(neardup.sketch_similarity(differing, 1000, 4096) - exact) < 0.05


def test_sketches_of_linked_pairs_pass():
    rng = np.random.default_rng(2)
    samples = neardup.bands_for(85) * neardup.ROWS
    most = neardup.most_differing_bits(85, samples)
    for _ in range(200):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        other = np.concatenate([base[:276], rng.integers(0, 2**63, 24).astype(np.uint64)])  # 276 of 324
        x, y = (neardup.odd_sketch(neardup.minhash(s, samples)) for s in (base, other))
        assert sum(int(v).bit_count() for v in (x ^ y).tolist()) <= most


def test_connected_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5000, 5000)]
    parent = {x: x for link in links for x in link}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: top(x) for x in parent}
    assert connect(spark.createDataFrame([], "a long, b long")).collect() == []
