import random
import tracemalloc

import numpy as np
import pyarrow as pa

from millrace.llm import pseudolm
from tests.llm.common import frame


def corpus(n, seed):
    """Texts in which a word follows from its neighbours."""
    rng = random.Random(seed)
    cycle = "the cat sat on a mat and then ran off".split()
    out = []
    for _ in range(n):
        start = rng.randrange(len(cycle))
        out.append(" ".join(cycle[(start + i) % len(cycle)] if rng.random() < 0.97 else f"odd{rng.randrange(50)}" for i in range(rng.randrange(20, 200))))
    return out


def test_scores_tell_order(spark):
    """On texts never trained on, the network beats word frequencies, and the same words in another order score less."""
    train = frame(spark, [(i, t, "s") for i, t in enumerate(corpus(400, 1))])
    words = pseudolm.frequent_words(train)
    coded = pseudolm.encode(train, words)
    net = pseudolm.train(coded)
    held = corpus(40, 2)
    rng = random.Random(3)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]

    def mean(texts):
        codes = [bytes(r.codes) for r in pseudolm.encode(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), words).collect()]
        near, own, _ = pseudolm.windows(codes)
        return net.log_probabilities(near, own).mean(), own

    real, own = mean(held)
    counts = np.bincount(np.frombuffer(b"".join(bytes(r.codes) for r in coded.collect()), np.uint8), minlength=pseudolm.CLASSES) + 1
    base = np.log(counts / counts.sum())[own].mean()
    assert real > base + 0.5 and real > mean(shuffled)[0] + 1


def test_sums_of_conditional_logarithms(spark):
    texts = ["", None, "  ", "one", "a b", *corpus(5, 4)]
    df = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[5], "s"), (5, texts[5], None)])
    out = pseudolm.score(df).collect()
    assert len(out) == len(texts) + 2
    words = pseudolm.frequent_words(df)
    coded = pseudolm.encode(df, words)
    net = pseudolm.train(coded)
    codes = {r.doc_id if "doc_id" in r else r.id: bytes(r.codes) for r in coded.collect()}
    for r in out:
        line = codes[r.doc_id]
        total = 0.0
        for i, word in enumerate(line):
            near = [line[j] if 0 <= j < len(line) else pseudolm.OUTSIDE for j in (i - 2, i - 1, i + 1, i + 2)]
            logits = np.tanh(net.bias + sum(net.near[k][c] for k, c in enumerate(near))) @ net.out + net.base
            total += logits[word] - np.log(np.exp(logits).sum())
        assert r.n_words == len(line) and abs(r.log_likelihood - total) < 1e-2
        assert r.mean_log_likelihood is None if not line else abs(r.mean_log_likelihood - total / len(line)) < 1e-3


def test_gradient():
    """A small step along the gradient raises the likelihood by its squared length."""
    rng = np.random.default_rng(1)
    near, words = rng.integers(0, pseudolm.CLASSES, (4, 50)), rng.integers(0, pseudolm.CLASSES, 50)
    net = pseudolm.Network(3)
    before = net.log_probabilities(near, words).mean()
    for _ in range(30):
        net.learn(near, words, [np.full(p.shape, 1e-4, np.float32) for p in net.parts], rate=0.01)
    assert net.log_probabilities(near, words).mean() > before + 0.1


def test_empty(spark):
    assert pseudolm.score(frame(spark, [])).collect() == []
    assert [r.n_words for r in pseudolm.score(frame(spark, [(1, None, "s")])).collect()] == [0]


def test_every_word_has_a_probability_of_its_own(spark):
    """Random letters score less than a rare word, the words of a class share its probability, neighbours differ."""
    rng = random.Random(5)
    parts = "ka lo mi ten sur fe ba rin do gal".split()
    words = list(dict.fromkeys("".join(rng.choices(parts, k=rng.randrange(2, 4))) for _ in range(700)))
    usual, rare = words[:300], words[300:]
    texts = [" ".join([*rng.choices(usual, k=150), *rare[i::40]]) for i in range(40)]
    pair = [" ".join([*usual[:2], w, *usual[2:4]]) for w in (rare[0], "xqzjvk")]
    df = frame(spark, [(i, t, "s") for i, t in enumerate([*texts, *pair])])
    vocabulary = pseudolm.frequent_words(df)
    assert len(vocabulary.counts) > 100 and {"xqzjvk", rare[0]}.isdisjoint(vocabulary.words)
    out = {r.doc_id: r.log_likelihood for r in pseudolm.score(df).collect()}
    assert out[len(texts)] > out[len(texts) + 1] + 5
    net = pseudolm.train(pseudolm.encode(df, vocabulary), counts=vocabulary.counts)
    own = np.arange(1, len(net.word) + 1)
    near, fine = np.zeros((4, len(own)), np.int64), np.zeros((4, len(own)), np.int64)
    group = (own - 1) % pseudolm.GROUPS
    gain = net.log_probabilities(near, pseudolm.FREQUENT + group, fine, own) - net.log_probabilities(near, pseudolm.FREQUENT + group)
    assert np.allclose(np.bincount(group, weights=np.exp(gain)), 1, atol=1e-4)
    assert np.abs(net.fine[own]).sum(axis=1).all() and len(np.unique(net.fine[own], axis=0)) == len(own)


def sample(seed=4, n=300, size=150):
    """A network with words within classes, and a line of three texts: neighbours, words, fine neighbours, line, places."""
    rng = np.random.default_rng(seed)
    net = pseudolm.Network(seed, rng.integers(5, 90, size))
    net.words[..., : pseudolm.HIDDEN] = rng.normal(0, 0.5, net.words[..., : pseudolm.HIDDEN].shape)
    net.fine[1:] = rng.normal(0, 0.5, net.fine[1:].shape)
    fine = rng.integers(0, size + 4, n).astype(np.int32) * (rng.random(n) < 0.8).astype(np.int32)
    classes = np.where(fine > size, pseudolm.REST, np.where(fine > 0, pseudolm.FREQUENT + (fine - 1) % pseudolm.GROUPS, rng.integers(0, 9, n))).astype(np.uint8)
    cuts = [(0, 1), (1, 120), (120, n)]
    near, words, _ = pseudolm.windows([classes[a:b].tobytes() for a, b in cuts])
    line, at = pseudolm.fine_line([fine[a:b].tobytes() for a, b in cuts])
    return net, near, words, np.stack([line[at + o] for o in pseudolm.OFFSETS]), line, at


def by_definition(net, near, words, fine, own):
    """Log-probabilities and the gradient of their negated mean by every weight, a word at a time in double precision."""
    p = [x.astype(np.float64) for x in net.parts]
    grads, logs, depth = [np.zeros_like(x) for x in p], [], pseudolm.HIDDEN
    for i, word in enumerate(words):
        h = np.tanh(p[1] + sum(p[0][k][near[k, i]] + p[4][fine[k, i]] for k in range(4)))
        heads = [(p[2].T, p[3], word, grads[2].T, grads[3])]
        if 0 < own[i] <= net.size:
            g, j = (own[i] - 1) % pseudolm.GROUPS, (own[i] - 1) // pseudolm.GROUPS
            heads.append((p[5][g, :, :depth], p[5][g, :, depth], j, grads[5][g, :, :depth], grads[5][g, :, depth]))
        log, back = 0.0, np.zeros(depth)
        for vectors, bias, which, by_vectors, by_bias in heads:
            z = vectors @ h + bias
            z -= z.max() + np.log(np.exp(z - z.max()).sum())
            log += z[which]
            error = (np.exp(z) - (np.arange(len(z)) == which)) / len(words)
            back += error @ vectors
            by_vectors += np.outer(error, h)
            by_bias += error
        logs.append(log)
        inner = back * (1 - h * h)
        grads[1] += inner
        for k in range(4):
            grads[0][k][near[k, i]] += inner
            if fine[k, i]:
                grads[4][fine[k, i]] += inner
    return np.array(logs), grads


def test_step_against_definition(monkeypatch):
    """Tiles of any size give the step of the definition, for classes, words within them and fine codes of neighbours."""
    for tile in (16, 512):
        monkeypatch.setattr(pseudolm, "TILE", tile)
        net, near, words, fine, line, at = sample()
        logs, grads = by_definition(net, near, words, fine, line[at])
        assert np.allclose(net.log_probabilities(near, words, fine, line[at]), logs, atol=1e-4)
        before, squares = [p.astype(np.float64) for p in net.parts], [np.full(p.shape, 1e-4, np.float32) for p in net.parts]
        net.learn(near, words, squares, 0.1, (line, at), line[at])
        for weight, old, gradient in zip(net.parts, before, grads):
            assert np.allclose(weight, old - 0.1 * gradient / (np.sqrt(1e-4 + gradient**2) + 1e-6), atol=2e-4)
            assert not np.array_equal(weight, old)


def test_sums_beyond_single_precision():
    net, near, words, fine, line, at = sample()
    for shift in (300, -300):
        net.base[:] = shift + np.arange(pseudolm.CLASSES) % 7
        net.words[..., pseudolm.HIDDEN] += shift
        logs, _ = by_definition(net, near, words, fine, line[at])
        found = net.log_probabilities(near, words, fine, line[at])
        assert np.isfinite(found).all() and np.allclose(found, logs, atol=2e-3)


def test_spelling_against_definition():
    words = [b"kalo", b"mi", b"x", "é".encode(), b"kalomi"]
    found, of = pseudolm.Spelling.trigrams(words)
    want = [((b"  " + w + b" ")[i : i + 3], k) for k, w in enumerate(words) for i in range(len(w) + 1)]
    assert [(int(t).to_bytes(3, "big"), int(k)) for t, k in zip(found, of)] == want
    assert len(pseudolm.Spelling.trigrams([])[0]) == 0
    keys, n = np.unique(found, return_counts=True)
    seen = {int(k): 10 * int(c) for k, c in zip(keys, n)}
    spelling = pseudolm.Spelling(keys.astype(np.int64), 10 * n)
    for word in [*words, b"zq", b"kax", b""]:
        total, line = 0.0, b"  " + word + b" "
        for a, b, c in zip(line, line[1:], line[2:]):
            short = [sum(v for k, v in seen.items() if k & 0xFFFF == (b << 8 | x)) for x in range(256)]
            likely = (short[c] + pseudolm.PRIOR / 256) / (sum(short) + pseudolm.PRIOR)
            given = sum(v for k, v in seen.items() if k >> 8 == (a << 8 | b))
            total += np.log((seen.get(a << 16 | b << 8 | c, 0) + pseudolm.PRIOR * likely) / (given + pseudolm.PRIOR))
        assert abs(spelling.log_probabilities([word])[0] - total) < 1e-9


def test_logits_are_held_a_tile_at_a_time():
    """Scoring a batch never holds the logits of all its words: they would leave the cache, which made it slow."""
    rng = np.random.default_rng(6)
    net = pseudolm.Network(1, np.full(20_000, 9))
    own = rng.integers(0, 20_001, 4096)
    words = np.where(own > 0, pseudolm.FREQUENT + (own - 1) % pseudolm.GROUPS, 3)
    near, fine = rng.integers(0, pseudolm.CLASSES, (4, 4096)), rng.integers(0, 20_001, (4, 4096))
    tracemalloc.start()
    found = net.log_probabilities(near, words, fine, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4096 and peak < 4096 * pseudolm.CLASSES * 4


def test_byte_list():
    words = pa.array(["", "é", "kalo", "b", "x y"], pa.large_string())
    assert pseudolm.byte_list(words.slice(1, 3)) == ["é".encode(), b"kalo", b"b"] and pseudolm.byte_list(words.slice(0, 0)) == []
    assert pseudolm.byte_list(pa.array(["a", "b"], pa.string())) == [b"a", b"b"]
