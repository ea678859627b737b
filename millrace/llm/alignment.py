"""Alignment of the token sequences of two tokenizers: groups between common ends, links, and corpus-wide link counts.

Two tokenizers cut the same bytes.  Where tokens of both end at one byte, a group ends; the tokens of a group are linked
with one another.  A byte range of a document is a *fragment*: the tokens up to its first common end (open prefix), the
groups after it (closed), and the tokens behind its last common end (open suffix), or, without a common end, open tokens
alone.  Fragments of neighbouring ranges compose associatively: suffix and next prefix make one group, everything else
stays.  So a very long document is cut into byte ranges that are tokenized and aligned in different tasks, and a tree of
compositions over Spark groups puts it together; other documents are one range each.

Texts are cut for tokenizing only at a space between two letters a-z, where neither vocabulary can join tokens; tokens
are dealt into byte ranges by their ends, so ranges cut through groups anywhere.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.packing import PATTERN
from millrace.llm.words import chunks
from millrace.session import settle, written

#: Vocabulary files on every executor.
BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of a range of a long document, and ranges composed at once.
RANGE, FAN_IN = 1 << 16, 16
#: Text bytes tokenized at once in a task.
BATCH_BYTES = 1 << 20
#: Links expanded at once, and links of one group from which equal ids are counted first.
LINKS, LARGE_GROUP = 1 << 21, 1 << 12
#: An id pair is one number: the first id, then so many bits of the second.
SECOND_BITS = 16
#: Distinct id pairs a task holds before it hands on their counts, and rows of link counts broadcast at once.
HELD_PAIRS, SLICE = 1 << 21, 1 << 21


class Vocabulary:
    """Token ids and the bytes of each id."""

    def __init__(self, tokens: list[bytes], encode):
        self.tokens, self.encode = tokens, encode
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.start[ids], size) + at].tobytes()


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_vocabulary(path: str = BYTE_MODEL) -> Vocabulary:
    """A byte-level vocabulary; its special tokens are not recognized in texts."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", [])}
    letters, vocab = _byte_letters(), model["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Vocabulary(tokens, lambda texts: [encoding.encode_ordinary(t) for t in texts])


@lru_cache(maxsize=2)
def piece_vocabulary(path: str = PIECE_MODEL) -> Vocabulary:
    """A piece vocabulary, which puts a space before the text itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("pieces go over a space, so texts cannot be cut there")
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    return Vocabulary(tokens, lambda texts: model.encode([t[1:] for t in texts], num_threads=1))


@dataclass
class Tokens:
    """Ids and byte ends of tokens of both tokenizers."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray


@dataclass
class Groups:
    """Closed groups of one or more documents: per document counts, text, and id pairs with their number of links."""

    groups: np.ndarray
    links: np.ndarray
    texts: list[bytes]
    owner: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


@lru_cache(maxsize=2)
def _decimals(many_a: int, many_b: int) -> list[bytes]:
    """Ids as text, each with the mark that follows inside a side and the one that follows its last id."""
    out = [f"{i}{mark}".encode() for i in range(many_a) for mark in ",|"]
    return out + [f"{i}{mark}".encode() for i in range(many_b) for mark in ",;"]


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal (owner, pair) added up, sorted."""
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])) if len(owner) else np.empty(0, np.int64)
    return owner[start], pair[start], np.add.reduceat(times, start) if len(start) else times


def _expanded(a: np.ndarray, wa: np.ndarray, ga: np.ndarray, b: np.ndarray, wb: np.ndarray, first_b: np.ndarray, many_b: np.ndarray, owner: np.ndarray) -> list[tuple]:
    """(owner, pair, times) for every pair of an A and a B entry of one group, a bounded number at a time."""
    out, many = [], many_b[ga]
    ends = np.cumsum(many)
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, side="right")))
        m = many[at:stop]
        j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first_b[ga[at:stop]], m)
        i = np.repeat(np.arange(at, stop), m)
        out.append(_summed(owner[ga[i]], a[i] << SECOND_BITS | b[j], wa[i] * wb[j]))
        at = stop
    return out


def closed(tokens: Tokens, common: np.ndarray, owner: np.ndarray, owners: int) -> Groups:
    """Groups that end at the ascending places ``common``; ``owner`` is the document of each, of ``owners``.

    All tokens end at or before the last place; ends ascend over the documents.
    """
    many = len(common)
    ga, gb = np.searchsorted(common, tokens.a_end), np.searchsorted(common, tokens.b_end)
    na, nb = np.bincount(ga, minlength=many), np.bincount(gb, minlength=many)
    ca, cb = np.cumsum(na), np.cumsum(nb)
    links = np.bincount(owner, weights=(na * nb).astype(float), minlength=owners).astype(np.int64)

    # both sequences in the order of the text, each id with the mark after it
    vocabulary = _decimals(1 << SECOND_BITS, 1 << SECOND_BITS)
    merged = np.empty(len(ga) + len(gb), np.int64)
    last_a, last_b = np.zeros(len(ga), np.int64), np.zeros(len(gb), np.int64)
    last_a[ca[na > 0] - 1], last_b[cb[nb > 0] - 1] = 1, 1
    merged[np.arange(len(ga)) + (cb - nb)[ga]] = 2 * tokens.a + last_a
    merged[np.arange(len(gb)) + ca[gb]] = (2 << SECOND_BITS) + 2 * tokens.b + last_b
    marked = list(map(vocabulary.__getitem__, merged.tolist()))
    stops = np.concatenate([[0], (ca + cb)])[np.searchsorted(owner, np.arange(owners + 1))].tolist()
    texts = [b"".join(marked[x:y])[:-1] for x, y in zip(stops, stops[1:])]

    large = na * nb > LARGE_GROUP
    ones = np.ones(max(len(ga), len(gb)), np.int64)
    some = ~large[ga]
    found = _expanded(tokens.a[some], ones, ga[some], tokens.b, ones, cb - nb, nb, owner)
    if large.any():  # equal ids of a group are counted before they are paired
        g, a, wa = _summed(ga[large[ga]], tokens.a[large[ga]], ones[: int(na[large].sum())])
        h, b, wb = _summed(gb[large[gb]], tokens.b[large[gb]], ones[: int(nb[large].sum())])
        distinct = np.bincount(h, minlength=many)
        found += _expanded(a, wa, g, b, wb, np.cumsum(distinct) - distinct, distinct, owner)
    empty = np.empty(0, np.int64)
    pairs = _summed(*(np.concatenate([empty, *x]) for x in zip(*found))) if found else (empty, empty, empty)
    return Groups(np.bincount(owner, minlength=owners), links, texts, *pairs)


@dataclass
class Fragment:
    """The tokens of a byte range as an element of the monoid; without ``cut`` all tokens are ``head``."""

    cut: bool
    head: tuple[np.ndarray, np.ndarray]
    tail: tuple[np.ndarray, np.ndarray]
    groups: int = 0
    links: int = 0
    text: list[bytes] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


NO_IDS = (np.empty(0, np.int64), np.empty(0, np.int64))
#: Neutral element, and the start of a document.
NOTHING, START = Fragment(False, NO_IDS, NO_IDS), Fragment(True, NO_IDS, NO_IDS)


def lift(tokens: Tokens) -> Fragment:
    """The fragment of the tokens that end in one byte range."""
    common = np.intersect1d(tokens.a_end, tokens.b_end, assume_unique=True)
    if not len(common):
        return Fragment(False, (tokens.a, tokens.b), NO_IDS)
    first, last = common[0], common[-1]
    a0, a1 = np.searchsorted(tokens.a_end, [first, last], side="right")
    b0, b1 = np.searchsorted(tokens.b_end, [first, last], side="right")
    out = Fragment(True, (tokens.a[:a0], tokens.b[:b0]), (tokens.a[a1:], tokens.b[b1:]))
    if len(common) > 1:
        inner = Tokens(tokens.a[a0:a1], tokens.a_end[a0:a1], tokens.b[b0:b1], tokens.b_end[b0:b1])
        done = closed(inner, common[1:], np.zeros(len(common) - 1, np.int64), 1)
        out.groups, out.links, out.text, out.pairs, out.times = int(done.groups[0]), int(done.links[0]), done.texts, done.pairs, done.times
    return out


def _joined(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not x.cut and not y.cut:
        return Fragment(False, _joined(x.head, y.head), NO_IDS)
    if not x.cut:
        return Fragment(True, _joined(x.head, y.head), y.tail, y.groups, y.links, y.text, y.pairs, y.times)
    if not y.cut:
        return Fragment(True, x.head, _joined(x.tail, y.head), x.groups, x.links, x.text, x.pairs, x.times)
    a, b = _joined(x.tail, y.head)
    groups, links, text, pairs, times = x.groups + y.groups, x.links + y.links, x.text + y.text, [x.pairs, y.pairs], [x.times, y.times]
    if len(a) or len(b):
        end = np.ones(1, np.int64)
        seam = closed(Tokens(a, np.ones(len(a), np.int64), b, np.ones(len(b), np.int64)), end, np.zeros(1, np.int64), 1)
        groups, links, text = groups + 1, links + int(seam.links[0]), [*x.text, seam.texts[0], *y.text]
        pairs, times = [*pairs, seam.pairs], [*times, seam.times]
    pairs, times = np.concatenate(pairs), np.concatenate(times)
    _, pairs, times = _summed(np.zeros(len(pairs), np.int64), pairs, times)
    return Fragment(True, x.head, y.tail, groups, links, text, pairs, times)


def tokenize(texts: list[str], first: Vocabulary, second: Vocabulary) -> tuple[list[Tokens], list[bool]]:
    """Tokens of each text, which begins with a space, and whether both sequences join to its bytes."""
    out, good = [], []
    for text, a, b in zip(texts, first.encode(texts), second.encode(texts)):
        a, b, raw = np.array(a, np.int64), np.array(b, np.int64), text.encode()
        a_end, b_end = np.cumsum(first.size[a]), np.cumsum(second.size[b])
        fits = all(len(e) and e[-1] == len(raw) for e in (a_end, b_end))
        good.append(bool(fits and first.joined(a) == raw and second.joined(b) == raw))
        out.append(Tokens(a, a_end, b, b_end))
    return out, good


RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _rows(a: list[int], b: list[int], groups: list[int], links: list[int], hashes: list[str], pairs: list[np.ndarray], times: list[np.ndarray]) -> list[pa.Array]:
    longs = [pa.array(x, pa.int64()) for x in (a, b, groups, links)]
    return [*longs, pa.array(hashes, pa.string()), pa.array([p.astype("<u4").tobytes() for p in pairs], pa.binary()), pa.array([t.astype("<u4").tobytes() for t in times], pa.binary())]


def _whole(df: DataFrame, models: tuple[str, str]) -> DataFrame:
    """(id, RESULT) of rows (id, text), each aligned in one piece; a batch of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_vocabulary(models[0]), piece_vocabulary(models[1])
        for part in chunks(batches, limit=BATCH_BYTES):
            bodies = part.column("text").to_pylist()
            some = [i for i, t in enumerate(bodies) if t]
            tokens, good = tokenize([" " + bodies[i] for i in some], first, second)
            some, tokens = [i for i, g in zip(some, good) if g], [t for t, g in zip(tokens, good) if g]
            n = len(bodies)
            counts = np.zeros((4, n), np.int64)
            hashes, pairs, times = [""] * n, [NO_IDS[0]] * n, [NO_IDS[0]] * n
            if some:
                base = np.cumsum([0, *(t.a_end[-1] for t in tokens)])
                both = Tokens(*(np.concatenate([getattr(t, k) + (s if k.endswith("end") else 0) for t, s in zip(tokens, base)]) for k in ("a", "a_end", "b", "b_end")))
                common = np.intersect1d(both.a_end, both.b_end, assume_unique=True)
                done = closed(both, common, np.searchsorted(base[1:], common), len(some))
                cuts = np.searchsorted(done.owner, np.arange(len(some) + 1))
                counts[:, some] = [[len(t.a) for t in tokens], [len(t.b) for t in tokens], done.groups, done.links]
                for k, i in enumerate(some):
                    hashes[i] = hashlib.sha256(done.texts[k]).hexdigest()
                    pairs[i], times[i] = done.pairs[cuts[k] : cuts[k + 1]], done.times[cuts[k] : cuts[k + 1]]
            yield pa.RecordBatch.from_arrays([part.column("id"), *_rows(*counts.tolist(), hashes, pairs, times)], ["id", *(c.split()[0] for c in RESULT.split(", "))])

    return df.select("id", "text").mapInArrow(run, f"id long, {RESULT}")


_CUT = re.compile("(?<=[a-z]) (?=[a-z])")

FRAGMENT = "n_a long, n_b long, cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary, groups long, links long, groups_text binary, pairs binary, times binary"


def parts(text: str, size: int) -> list[tuple[int, str]]:
    """(first byte, text) of pieces of ``" " + text`` that each begin with a space and are tokenized alike alone."""
    out, at, byte, text = [], 0, 0, " " + text
    while at < len(text):
        found = _CUT.search(text, at + size)
        stop = found.start() if found else len(text)
        out.append((byte, text[at:stop]))
        byte += len(text[at:stop].encode())
        at = stop
    return out


def _fragment_row(f: Fragment, n_a: int, n_b: int) -> list:
    raw = [np.asarray(x, "<i4").tobytes() for x in (*f.head, *f.tail)]
    return [n_a, n_b, f.cut, *raw, f.groups, f.links, b";".join(f.text), f.pairs.astype("<u4").tobytes(), f.times.astype("<u4").tobytes()]


def _fragment(row: dict) -> Fragment:
    ids = [np.frombuffer(row[k], "<i4").astype(np.int64) for k in ("head_a", "head_b", "tail_a", "tail_b")]
    pairs, times = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("pairs", "times"))
    return Fragment(row["cut"], (ids[0], ids[1]), (ids[2], ids[3]), row["groups"], row["links"], [row["groups_text"]] if row["groups_text"] else [], pairs, times)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _in_ranges(df: DataFrame, models: tuple[str, str], size: int, fan_in: int) -> DataFrame:
    """(id, RESULT) of long texts: pieces tokenized and lifted by byte range in tasks of their own, composed as a tree."""
    long = written(df.select("id", "text").withColumn("row", F.monotonically_increasing_id()))
    most = long.agg(F.max(F.octet_length("text"))).first()[0]
    if most is None:
        return long.limit(0).mapInArrow(lambda batches: iter(()), f"id long, {RESULT}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=BATCH_BYTES):
            for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()):
                starts, texts = zip(*parts(text, size))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(texts), pa.int64()), pa.array(starts, pa.int64()), pa.array(texts, pa.string())], ["row", "start", "text"])

    fragments, shape = f"row long, start long, good boolean, {FRAGMENT}", _arrow_schema(f"row long, start long, good boolean, {FRAGMENT}")

    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = byte_vocabulary(models[0]), piece_vocabulary(models[1])
        for part in chunks(batches, limit=1):
            row, start, text = (part.column(c)[0].as_py() for c in ("row", "start", "text"))
            (t,), (good,) = tokenize([text], first, second)
            out = []
            if not good:
                out.append([row, start, False, *_fragment_row(NOTHING, 0, 0)])
            else:
                stop = start + len(text.encode())
                for at in range(start - start % size, stop, size):  # byte ranges of the document, not of the piece
                    a = slice(*np.searchsorted(t.a_end, [at - start, at + size - start], side="right"))
                    b = slice(*np.searchsorted(t.b_end, [at - start, at + size - start], side="right"))
                    f = lift(Tokens(t.a[a], t.a_end[a], t.b[b], t.b_end[b]))
                    out.append([row, max(at, start), True, *_fragment_row(f, a.stop - a.start, b.stop - b.start)])
            yield _batch(out, shape)

    def composed(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["start"])
        f = _fragment(rows[0])
        for r in rows[1:]:
            f = compose(f, _fragment(r))
        total = [sum(r[k] for r in rows) for k in ("n_a", "n_b")]
        return pa.Table.from_batches([_batch([[rows[0]["row"], rows[0]["start"], all(r["good"] for r in rows), *_fragment_row(f, *total)]], shape)])

    names = [c.split()[0] for c in RESULT.split(", ")]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = compose(START, _fragment(r))
                columns = _rows([r["n_a"]], [r["n_b"]], [f.groups], [f.links], [hashlib.sha256(b";".join(f.text)).hexdigest()], [f.pairs], [f.times])
                if not r["good"]:
                    columns = _rows([0], [0], [0], [0], [""], [NO_IDS[0]], [NO_IDS[0]])
                yield pa.RecordBatch.from_arrays([pa.array([r["row"]], pa.int64()), *columns], ["row", *names])

    pieces = long.select("row", "text").mapInArrow(cut, "row long, start long, text string")
    now = settle(pieces.repartition("row", "start").mapInArrow(lifted, fragments))
    width = size
    while width <= most:
        width *= fan_in
        now = now.withColumn("part", F.floor(F.col("start") / width)).groupBy("row", "part").applyInArrow(lambda t: composed(t.drop_columns("part")), fragments)
    return long.select("row", "id").join(now.mapInArrow(finished, f"row long, {RESULT}"), "row").drop("row")


def align(df: DataFrame, id: str = "doc_id", text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, size: int = RANGE, fan_in: int = FAN_IN) -> DataFrame:
    """(id, RESULT) of every row: tokens of ``space + text`` in both vocabularies, aligned.

    ``pairs`` holds the distinct linked id pairs of the document, ascending, as little-endian 32-bit numbers (first id
    times 65 536 plus second id), ``times`` the links of each.  ``groups_sha256`` hashes the groups as text.  Null and
    empty texts, and texts whose tokens do not join to their bytes, have no tokens.  Null and repeated ids stay; rows
    of equal text get equal results; other columns are ignored; an empty table gives an empty result.
    """
    models = (byte_model, piece_model)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    return _whole(rows.filter(~long), models).union(_in_ranges(rows.filter(long), models, size, fan_in)).withColumnRenamed("id", id)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows of ``aligned`` hold each id pair linked, for the pairs of two rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([x for x, _ in held])
            _, pairs, n = _summed(np.zeros(len(pairs), np.int64), pairs, np.concatenate([y for _, y in held]))
            return pairs, n

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for raw in batch.column("pairs").to_pylist():
                pairs = np.frombuffer(raw, "<u4").astype(np.int64)
                held.append((pairs, np.ones(len(pairs), np.int64)))
                size += len(pairs)
                if size > 2 * HELD_PAIRS:
                    held = [added()]
                    size = len(held[0][0])
                    if size > HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], ["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(run, "pair long, n long")
    return counts.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")


def _slices(counts: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of first ids that together have all of them; each has at most ``limit`` pairs, or is one id."""
    per = {r["a"]: r["m"] for r in counts.groupBy(F.shiftright("pair", SECOND_BITS).alias("a")).agg(F.count("*").alias("m")).collect()}
    out, low, held = [], 0, 0
    for a in range(1 << SECOND_BITS):
        if held and held + per.get(a, 0) > limit:
            out.append((low, a))
            low, held = a, 0
        held += per.get(a, 0)
    return [*out, (low, 1 << SECOND_BITS)]


def with_corpus_counts(aligned: DataFrame, limit: int = SLICE) -> DataFrame:
    """``aligned`` without pairs, and with ``n_best`` (links whose count is the highest of their first id) and ``count_sum``.

    The counts of all pairs of two rows or more reach the tasks by broadcast, in as many slices by first id as hold at
    most ``limit`` of them, one pass over ``pairs`` each (a single first id has at most 65 536); other pairs count 1.
    """
    spark = aligned.sparkSession
    stored = written(aligned.withColumn("_row", F.monotonically_increasing_id()))
    counts = settle(link_counts(stored))

    def scored(low: int, high: int) -> DataFrame:
        part = counts.filter((F.col("pair") >= low << SECOND_BITS) & (F.col("pair") < high << SECOND_BITS)).orderBy("pair").toArrow()
        pair, n = part.column("pair").to_numpy(), part.column("n").to_numpy()
        best = np.ones(high - low, np.int64)
        np.maximum.at(best, (pair >> SECOND_BITS) - low, n)
        shared = spark.sparkContext.broadcast((pair.astype("<u4"), n.astype("<i8" if len(n) and n.max() >> 31 else "<i4"), best))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = shared.value
            for batch in batches:
                pairs = [np.frombuffer(x, "<u4") for x in batch.column("pairs").to_pylist()]
                times = np.concatenate([NO_IDS[0], *(np.frombuffer(x, "<u4") for x in batch.column("times").to_pylist())])
                owner = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
                flat = np.concatenate([np.empty(0, "<u4"), *pairs])
                inside = (flat >> SECOND_BITS >= low) & (flat >> SECOND_BITS < high)
                flat, times, owner = flat[inside], times[inside], owner[inside]
                found = np.ones(len(flat), np.int64)
                if len(pair):
                    at = np.minimum(np.searchsorted(pair, flat), len(pair) - 1)
                    found = np.where(pair[at] == flat, n[at], 1).astype(np.int64)
                top = found == best[(flat >> SECOND_BITS).astype(np.int64) - low]
                sums = np.zeros((2, len(pairs)), np.int64)
                np.add.at(sums[0], owner[top], times[top])
                np.add.at(sums[1], owner, times * found)
                yield pa.RecordBatch.from_arrays([batch.column("_row"), *map(pa.array, sums)], ["_row", "n_best", "count_sum"])

        return stored.select("_row", "pairs", "times").mapInArrow(run, "_row long, n_best long, count_sum long")

    total = None
    for low, high in _slices(counts, limit):
        part = scored(low, high)
        total = part if total is None else total.union(part)
    total = total.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.drop("pairs", "times").join(total, "_row").drop("_row")
