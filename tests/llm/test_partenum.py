import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import partenum
from tests.llm.common import frame, lowered


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(rows):
    found = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def brute(words):
    mates = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(mates[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(mates[w]), words.get(form[w])) for w, n in words.items()}


def edits(rng, word):
    letters = "abcdefghijklmnopqrstuvwxyzéßÿ"
    at, kind = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if kind == 0 else rng.choice(letters)) + word[at + (kind != 1) :]


@pytest.fixture(scope="module")
def rows():
    """Words, their misspellings of misspellings, anagrams, repeated letters, one word very often."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeorst") for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    words = base + [edits(rng, w) for w in base for _ in range(6)]
    words += [edits(rng, w) for w in words[60:200]] + ["".join(rng.sample("listenings", 10)) for _ in range(80)]
    words += ["a" * n for n in range(6, 14)] + ["ab" * 4, "ba" * 4, "Ünlücké", "ünlücké", "élèvesÿ"]
    many = [w for w in words for _ in range(rng.choice([1, 2, 3, 30, 400]))]
    rng.shuffle(many)
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in many[i : i + 40]) for i in range(0, len(many), 40)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return rows + [(None, texts[0], "s"), (3, texts[3], "s"), (7, None, "s"), (8, "", "s"), (9, "x×y÷z 1234567 abc-defghij", "s")]


@pytest.mark.parametrize("crowd", [partenum.CROWD, 2])
def test_variants(spark, rows, crowd, monkeypatch):
    monkeypatch.setattr(partenum, "CROWD", crowd)
    out = partenum.spelling_variants(frame(spark, rows)).collect()
    want = brute(brute_words(rows))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want
    assert len(out) == len(want)
    assert any(r.root not in (r.word, r.form) for r in out)  # chains are followed to their end


def test_groups_across_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        words = spark.createDataFrame([(w, n) for w, n in brute_words(rows[:120]).items()], "word string, n long")
        found = {(r.a, r.b) for r in partenum.near_pairs(words).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = sorted(w for w in brute_words(rows[:120]))
    assert found == {(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if near(a, b)}


def test_signatures_of_near_words_meet():
    rng = random.Random(6)
    import numpy as np

    part = partenum.deal(np.arange(partenum.CODES * partenum.COUNTED), partenum.EQUAL_PARTS)
    for _ in range(300):
        a = "".join(rng.choice("abcdefÿ") for _ in range(rng.randrange(7, 30)))
        at = rng.randrange(len(a))
        b = a[:at] + rng.choice("xyz") + a[at + 1 :]
        x, y = partenum.enumerated([a, b], part, partenum.EQUAL_PARTS, 2, np.array([len(a), len(b)]))
        assert (x == y).any()


def test_long_words_and_empty(spark):
    long = "abcdefgh" * 3000
    rows = [(1, long, "s"), (2, long, "s"), (3, long + "z", "s"), (4, long + "z", "s"), (5, "z" + long[1:], "s"), (6, "z" + long[1:], "s")]
    out = {r.word: r for r in partenum.spelling_variants(frame(spark, rows)).collect()}
    words = brute_words(rows)
    assert {w: r.n for w, r in out.items()} == words
    assert all(r.n_near == sum(near(w, v) for v in words) for w, r in out.items())
    assert partenum.spelling_variants(frame(spark, [])).collect() == []
    assert partenum.spelling_variants(frame(spark, [(1, None, "s"), (2, "short words", "s")])).collect() == []
