import hashlib
import os
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from millrace.llm import alignment
from tests.llm.common import frame

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@lru_cache(maxsize=1)
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.BYTE_MODEL)
    first.encode_special_tokens = True
    letters = alignment._byte_letters()
    bytes_of = {i: bytes(letters.get(c, 0) for c in t) for t, i in first.get_vocab().items()}
    return first, bytes_of, SentencePieceProcessor(model_file=alignment.PIECE_MODEL)


def brute_groups(text):
    """Groups as lists of ids on both sides, straight from the libraries; None if the bytes differ."""
    first, bytes_of, second = libraries()
    if not text:
        return None
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    token_bytes = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    sides = [[(i, bytes_of[i]) for i in a], [(i, token_bytes(i)) for i in b]]
    if any(b"".join(t for _, t in s) != (" " + text).encode() for s in sides):
        return None
    ends = []
    for s in sides:
        at, out = 0, []
        for _, t in s:
            at += len(t)
            out.append(at)
        ends.append(out)
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, at = [], [0, 0]
    for c in common:
        group = []
        for k in (0, 1):
            stop = ends[k].index(c, at[k]) + 1
            group.append([i for i, _ in sides[k][at[k] : stop]])
            at[k] = stop
        groups.append(group)
    return groups


def brute(rows):
    found = [brute_groups(t) for _, t, _ in rows]
    linked = [Counter((a, b) for x, y in g or [] for a in x for b in y) for g in found]
    count = Counter(p for one in linked for p in one)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for (doc, _, _), groups, links in zip(rows, found, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or [])
        out.append((
            doc, sum(len(x) for x, _ in groups or []), sum(len(y) for _, y in groups or []), len(groups or []), sum(links.values()),
            sum(m for p, m in links.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = "the quick Brown foxes über déjà naïve 北京 東京タワー 123 4567 tokenization internationalisation <|endoftext|> <s> </s> <unk> <0x41> \n \t  don't we'll x=1;y+=2 🙂🙃 ﬁ Ω ć".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += ["a", " ", "  two spaces", "trailing ", "\n\n\n", "under▁score", "▁", "é combining", " nbsp ", "　wide", "nul\x00l", "﻿bom", "a" * 3000, "ab" * 900 + " " + "é" * 700, "北" * 400, " " * 500 + "x"]
    texts += ["".join(rng.choice("abcdefgh北é \n") for _ in range(600)) for _ in range(10)]
    return [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[0], "s"), (1, texts[1], "s"), (500, None, "s"), (501, "", "s")]


def collected(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return Counter(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("size, fan_in, limit", [(1 << 16, 16, 1 << 21), (40, 2, 200)])
def test_contract(spark, rows, size, fan_in, limit):
    out = alignment.with_corpus_counts(alignment.align(frame(spark, rows), size=size, fan_in=fan_in), limit)
    assert collected(out) == Counter(brute(rows))


def test_blocks_and_large_groups(spark, rows, monkeypatch):
    for name, value in (("LINKS", 5), ("LARGE_GROUP", 2), ("HELD_PAIRS", 7), ("BATCH_BYTES", 300)):
        monkeypatch.setattr(alignment, name, value)
    first, second = alignment.byte_vocabulary(), alignment.piece_vocabulary()
    for _, text, _ in rows:
        groups = brute_groups(text)
        if groups:
            (t,), (good,) = alignment.tokenize([" " + text], first, second)
            f = alignment.compose(alignment.START, alignment.lift(t))
            want = Counter(a << 16 | b for x, y in groups for a in x for b in y)
            assert good and dict(zip(f.pairs.tolist(), f.times.tolist())) == want


def test_composition_is_associative(rows):
    first, second = alignment.byte_vocabulary(), alignment.piece_vocabulary()
    rng = random.Random(1)
    same = lambda x, y: alignment._fragment_row(x, 0, 0) == alignment._fragment_row(y, 0, 0)
    for _, text, _ in rows[:70]:
        if not text:
            continue
        (t,), _ = alignment.tokenize([" " + text], first, second)
        end = int(t.a_end[-1])
        cuts = sorted(rng.randrange(end + 1) for _ in range(5))
        fragments = []
        for x, y in zip([0, *cuts], [*cuts, end]):
            a, b = (slice(*np.searchsorted(e, [x, y], side="right")) for e in (t.a_end, t.b_end))
            fragments.append(alignment.lift(alignment.Tokens(t.a[a], t.a_end[a], t.b[b], t.b_end[b])))
        whole = alignment.lift(t)
        for _ in range(4):
            left = list(fragments)
            while len(left) > 1:
                i = rng.randrange(len(left) - 1)
                left[i : i + 2] = [alignment.compose(left[i], left[i + 1])]
            assert same(left[0], whole)
        assert same(alignment.compose(alignment.NOTHING, whole), whole) and same(alignment.compose(whole, alignment.NOTHING), whole)


def test_pieces_are_tokenized_alike():
    first, second = alignment.byte_vocabulary(), alignment.piece_vocabulary()
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("abcXY 12.,  é\n") for _ in range(rng.randrange(1, 400)))
        whole = alignment.tokenize([" " + text], first, second)[0][0]
        cut = alignment.parts(text, 5)
        assert "".join(t for _, t in cut) == " " + text
        some = alignment.tokenize([t for _, t in cut], first, second)[0]
        assert np.concatenate([t.a for t in some]).tolist() == whole.a.tolist()
        assert np.concatenate([t.b for t in some]).tolist() == whole.b.tolist()


def test_empty(spark):
    out = alignment.with_corpus_counts(alignment.align(frame(spark, [])))
    assert out.collect() == []
    assert collected(alignment.with_corpus_counts(alignment.align(frame(spark, [(None, None, "s")])))) == Counter([(None, 0, 0, 0, 0, 0, 0, "")])
