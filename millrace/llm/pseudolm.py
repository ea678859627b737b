"""Document scores by masked pseudo-likelihood.

A small network predicts every word of a text from the words on both sides of it: each of the ``2 * SIDE`` neighbours
adds a vector that depends on the neighbour and its distance, and a softmax over the vocabulary reads their ``tanh``.
The logarithm of the probability given to the word that stands there, summed over the text, is the text's score.

Every word has a probability of its own, in up to three factors.  The most frequent words are classes by themselves.
Every other word that makes up at least one in ``SHARE`` running words of the corpus (and occurs ``LEAST`` times) is in
one of ``GROUPS`` classes, and a second softmax over the words of that class tells which it is.  All rarer words are one
class, and such a word is spelt byte by byte by a trigram model, from counts of all rarer words of the corpus.  As a
neighbour, each vocabulary word has a vector of its own besides that of its class; rarer words share ``TAILS`` of them.

Training runs in numpy inside Spark tasks: in each round every task fits the current network to its share of the
documents, and the networks are averaged by words seen.  All documents train once, a different part of them in each
round.  What a task holds is one batch and one network, whose size follows the vocabulary (at most ``SHARE`` words).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import append_columns, chunks, split_words
from millrace.session import written

#: Classes of words: frequent ones of their own, groups of vocabulary words, and one for the rest.  A class is one byte.
FREQUENT, GROUPS = 112, 64
REST = FREQUENT + GROUPS
CLASSES = REST + 1
OUTSIDE = CLASSES  # the neighbour beyond either end of a text
#: Words of at least one in SHARE running words, and LEAST occurrences, are in the vocabulary.
SHARE, LEAST = 1 << 18, 5
#: Vectors that neighbours outside the vocabulary share.
TAILS = 1024
SIDE, HIDDEN = 2, 16
OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]
ROUNDS, BATCH, RATE = 4, 4096, 0.15
#: Weights that are added up as one row.
BLOCK = 4096
#: Words whose logits are held at once, so that they stay in a core's cache, and words scored at once.
TILE, SCORED = 512, 1 << 13
#: Text bytes whose words are counted or looked up at once; a word that occurs again there costs nothing more.
TEXT_BYTES = 16 << 20
#: Bias of a place without a word.
EMPTY = -1e4
#: Occurrences that the shorter context of a byte counts for; a word seen once must not pass for its own evidence.
PRIOR = 20.0


def byte_list(words: pa.Array) -> list[bytes]:
    """The words in UTF-8; by way of numpy in a fraction of the time that a scalar for each takes."""
    return words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


class Spelling:
    """Probability of a word byte by byte, each given the two before it; a blank stands before and after a word."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = keys[order].astype(np.int64), counts[order].astype(np.float64)

    @cached_property
    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each two bytes, logarithm of the probability of each byte after them, row by row).  Two bytes that
        were never seen share the row of the second."""
        pairs = np.bincount(self.keys & 0xFFFF, weights=self.n, minlength=1 << 16).reshape(256, 256)
        short = (pairs + PRIOR / 256) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
        seen, of = np.unique(self.keys >> 8, return_inverse=True)
        row = np.arange(1 << 16) & 0xFF
        row[seen] = 256 + np.arange(len(seen))
        given = np.bincount(of, weights=self.n, minlength=len(seen))
        likely = np.vstack([short, PRIOR * short[seen & 0xFF]])
        likely[256 + of, self.keys & 0xFF] += self.n
        likely[256:] /= (given + PRIOR)[:, None]
        return row, np.log(likely, out=likely).ravel()

    @staticmethod
    def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(trigram, number of its word) of all bytes of some words and the blanks that end them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
        line = np.frombuffer(b"  " + b"   ".join(words) + b" ", np.uint8).astype(np.int32)
        whole = np.ones(len(line) - 2, bool)
        for k in (2, 1):
            whole[(np.cumsum(sizes) - k)[:-1]] = False  # those that reach into the next word
        found = (line[:-2] << 16 | line[1:-1] << 8 | line[2:])[whole]
        return found[: int(sizes.sum()) - 2 * len(words)], np.repeat(np.arange(len(words)), sizes - 2)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        found, of = self.trigrams(words)
        row, logs = self.logs
        return np.bincount(of, weights=logs[row[found >> 8] << 8 | found & 0xFF], minlength=len(words))


@dataclass
class Vocabulary:
    """Words by falling count, the counts of those that are no class of their own, and the spelling of all others."""

    words: list[str]
    counts: np.ndarray
    spelling: Spelling


def frequent_words(df: DataFrame, text: str = "text") -> Vocabulary:
    """The vocabulary of all texts (ASCII lower case), ties by code point."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=TEXT_BYTES):
            codes, words, _ = split_words(part.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "word"):
            found, of = Spelling.trigrams(byte_list(part.column("word")))
            keys, at = np.unique(found, return_inverse=True)
            n = np.bincount(at, weights=part.column("n").to_numpy()[of], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n)], ["k", "n"])

    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST, -(-total // SHARE))
    first = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    own = {w for w, _ in first}
    others = sorted(((-r["n"], r["word"]) for r in counts.filter(F.col("n") >= least).collect() if r["word"] not in own))
    rare = counts.filter(F.col("n") < least).mapInArrow(spell, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    spelling = Spelling(rare["k"].to_numpy(np.int64), rare["n"].to_numpy(np.int64))
    return Vocabulary([w for w, _ in first] + [w for _, w in others], np.array([-n for n, _ in others], np.int64), spelling)


def encode(df: DataFrame, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, codes, fine, spelt): the words of each text as classes of one byte each and as 32-bit integers, and the
    logarithm of the probability of spelling those outside the vocabulary.

    ``fine`` is 0 for a word that is a class, 1 + its place for another word of the vocabulary, and beyond that a hash.
    """

    def make():
        known = pa.array(vocabulary.words, pa.large_string())
        size, spelling = len(vocabulary.counts), vocabulary.spelling

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            codes, dictionary, bounds = split_words(batch.column("text"), lower=True)
            own = pc.fill_null(pc.index_in(dictionary, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rare = np.flatnonzero(own < 0)
            hard = byte_list(dictionary.take(pa.array(rare)))
            spelt = np.zeros(len(own))
            spelt[rare] = spelling.log_probabilities(hard)
            fine = np.maximum(own - FREQUENT + 1, 0)
            classes = np.where(fine > 0, FREQUENT + (fine - 1) % GROUPS, own)
            fine[rare] = 1 + size + (np.fromiter(map(xxhash.xxh3_64_intdigest, hard, repeat(9)), np.uint64, len(hard)) % np.uint64(TAILS)).astype(np.int64)
            classes[rare] = REST
            of = np.repeat(np.arange(len(batch)), np.diff(bounds))
            sums = np.bincount(of, weights=spelt.take(codes), minlength=len(batch)).astype(np.float64)

            def cut(values: np.ndarray) -> pa.Array:
                ends = pa.py_buffer(bounds.astype(np.int32) * np.int32(values.itemsize))
                return pa.Array.from_buffers(pa.binary(), len(batch), [None, ends, pa.py_buffer(values.take(codes))])

            return [cut(classes.astype(np.uint8)), cut(fine.astype(np.int32)), pa.array(sums)]

        return work

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    new = {"codes": "binary", "fine": "binary", "spelt": "double"}
    return append_columns(rows, {"text": "body"}, new, make, by="text", limit=TEXT_BYTES, keep=["id"])


class Network:
    """Weights as single-precision arrays: a table per neighbour, a bias, an output matrix and its bias; and for words
    within a class what each adds as a neighbour, and class by class an output vector each with its bias, at first the
    logarithm of the count.  Places that a class lacks hold ``EMPTY`` and get no probability."""

    def __init__(self, seed: int = 0, counts: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        counts = np.empty(0) if counts is None else counts
        self.near = rng.normal(0, 0.1, (2 * SIDE, CLASSES + 1, HIDDEN)).astype(np.float32)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32)
        self.base = np.zeros(CLASSES, np.float32)
        self.fine = np.zeros((1 + len(counts) + TAILS, HIDDEN), np.float32)
        self.size = len(counts)
        often = np.full(-(-self.size // GROUPS) * GROUPS, EMPTY, np.float32)
        often[: self.size] = np.log(counts)
        self.words = np.zeros((GROUPS, len(often) // GROUPS, HIDDEN + 1), np.float32)
        self.words[..., HIDDEN] = often.reshape(-1, GROUPS).T

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.near, self.bias, self.out, self.base, self.fine, self.words]

    @property
    def word(self) -> np.ndarray:
        """The output vector of each word within a class."""
        return self.words[..., :HIDDEN].transpose(1, 0, 2).reshape(-1, HIDDEN)[: self.size]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @staticmethod
    def of(flat: np.ndarray, size: int = 0) -> Network:
        net = Network(0, np.ones(size))
        for p in net.parts:
            p[...], flat = flat[: p.size].reshape(p.shape), flat[p.size :]
        return net

    def hidden(self, neighbours: np.ndarray, fine: Sequence[np.ndarray] | None = None) -> np.ndarray:
        """The hidden layer, and a column of ones for biases."""
        total = self.near[0].take(neighbours[0], axis=0, mode="clip")
        total += self.bias
        for table, words in zip(self.near[1:], neighbours[1:]):
            total += table.take(words, axis=0, mode="clip")
        for words in fine if fine is not None else ():
            total += self.fine.take(words, axis=0, mode="clip")
        h = np.ones((len(total), HIDDEN + 1), np.float32)
        np.tanh(total, out=h[:, :HIDDEN])
        return h

    def within(self, own: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """(classes, places in ``own`` that hold one of their words, which one, (class, first place, last) of each), a
        tile of whole classes at a time."""
        at = np.flatnonzero((own > 0) & (own <= self.size))
        place = own[at] - 1
        group = (place % GROUPS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        at, place = at[order], place[order] // GROUPS
        ends = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        first = 0
        for group in range(1, GROUPS + 1):
            if ends[group] > ends[first] and (group == GROUPS or ends[group + 1] - ends[first] > TILE):
                part = slice(ends[first], ends[group])
                yield slice(first, group), at[part], place[part], [(g, ends[g] - part.start, ends[g + 1] - part.start) for g in range(first, group) if ends[g + 1] > ends[g]]
                first = group

    def _deep(self, h: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
        logits = np.empty((len(h), self.words.shape[1]), np.float32)
        for g, a, b in cuts:
            np.matmul(h[a:b], self.words[g].T, out=logits[a:b])
        return logits

    def log_probabilities(self, neighbours: np.ndarray, words: np.ndarray, fine: Sequence[np.ndarray] | None = None, own: np.ndarray | None = None) -> np.ndarray:
        """Logarithm of the probability of each word given its neighbours (2 * SIDE rows of codes).

        Without ``fine`` and ``own``, the fine codes of neighbours and words, this is that of the class alone.
        """
        h, classes = self.hidden(neighbours, fine), np.vstack([self.out, self.base])
        found = np.empty(len(words), np.float32)
        for a in range(0, len(words), TILE):
            part = slice(a, a + TILE)
            _, total, chosen = exponentials(lambda: h[part] @ classes, words[part])
            found[part] = chosen - np.log(total)
        if own is not None:
            for _, at, which, cuts in self.within(own):
                rows = h.take(at, axis=0)
                _, total, chosen = exponentials(lambda: self._deep(rows, cuts), which)
                found[at] += chosen - np.log(total)
        return found

    def learn(self, neighbours: np.ndarray, words: np.ndarray, squares: list[np.ndarray], rate: float = RATE, fine: tuple[np.ndarray, np.ndarray] | None = None, own: np.ndarray | None = None) -> None:
        """One step of gradient descent with a rate per weight that falls with the squares of its gradients.

        ``fine`` are the fine codes of a line of texts, with at least ``SIDE`` zeros between them, and the words' places.
        """
        line, at = fine or (None, None)
        h, classes = self.hidden(neighbours, fine and [line.take(at + o) for o in OFFSETS]), np.vstack([self.out, self.base])

        def step(weight: np.ndarray, gradient: np.ndarray, square: np.ndarray) -> None:
            by = gradient * gradient
            square += by
            np.sqrt(square, out=by)
            by += 1e-6
            np.divide(gradient, by, out=by)
            by *= rate
            weight -= by

        def errors(logits: Callable[[], np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # errors of a row, and what they are to be multiplied by: cheaper on the hidden layer than on all classes
            e, total, _ = exponentials(logits, which)
            e[np.arange(len(which)), which] -= total
            return e, (1 / (total * len(words)))[:, None]

        back = np.empty((len(words), HIDDEN), np.float32)
        outer = np.zeros_like(classes.T)
        for a in range(0, len(words), TILE):
            part = slice(a, a + TILE)
            e, scale = errors(lambda: h[part] @ classes, words[part])
            np.multiply(e @ self.out.T, scale, out=back[part])
            outer += e.T @ (h[part] * scale)
        if own is not None:
            for groups, row, which, cuts in self.within(own):
                rows = h.take(row, axis=0)
                e, scale = errors(lambda: self._deep(rows, cuts), which)
                rows *= scale
                vectors, deep = np.zeros_like(self.words[groups]), np.empty((len(row), HIDDEN), np.float32)
                for g, a, b in cuts:
                    np.matmul(e[a:b], self.words[g, :, :HIDDEN], out=deep[a:b])
                    np.matmul(e[a:b].T, rows[a:b], out=vectors[g - groups.start])
                deep *= scale
                back[row] += deep
                step(self.words[groups], vectors, squares[5][groups])
        h = h[:, :HIDDEN]
        inner = back * (1 - h * h)
        places = np.arange(HIDDEN)[:, None]

        def sums(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
            return np.bincount((places * size + codes).ravel(), weights=weights, minlength=HIDDEN * size).reshape(HIDDEN, size).T

        near, weights = np.empty_like(self.near), inner.T.astype(np.float64).ravel()
        for table, codes in zip(near, neighbours):
            table[...] = sums(codes, weights, len(table))
        for weight, gradient, square in zip(self.parts, [near, inner.sum(axis=0), outer[:, :HIDDEN].T, outer[:, HIDDEN]], squares):
            step(weight, gradient, square)
        if line is not None:
            first, size = at[0] - SIDE, at[-1] - at[0] + 1 + 2 * SIDE
            spread = np.zeros((size + 2 * SIDE, HIDDEN), np.float32)
            spread[at - first + SIDE] = inner
            total, codes = sum(spread[SIDE - o : SIDE - o + size] for o in OFFSETS), line[first : first + size]
            number = np.zeros(len(self.fine), np.int64)
            number[codes] = 1
            number[0] = 1  # no word of its own: summed with the others, and left out
            used = np.flatnonzero(number)
            number[used] = np.arange(len(used))
            total = sums(number.take(codes), total.T.astype(np.float64).ravel(), len(used))[1:]
            used = used[1:]
            weight, square = self.fine.take(used, axis=0), squares[4].take(used, axis=0)
            step(weight, total.astype(np.float32, order="C"), square)
            self.fine[used], squares[4][used] = weight, square


def exponentials(logits: Callable[[], np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exponentials, their sum, the logarithm that ``which`` names) of each row of ``logits()``.  Only if a sum could
    leave the range of single precision, the largest logarithm of each row is taken off first."""
    e = logits()
    rows, ones = np.arange(len(which)), np.ones(e.shape[1], np.float32)
    chosen = e[rows, which]
    with np.errstate(over="ignore"):
        np.exp(e, out=e)
        total = e @ ones
    if len(e) and not (total.min() > 1e-20 and total.max() < 1e20):
        e = logits()
        top = e.max(axis=1)
        chosen -= top
        np.exp(np.subtract(e, top[:, None], out=e), out=e)
        total = e @ ones
    return e, total, chosen


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) + SIDE * (of + 1)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, words, text number) of all words of some texts; texts do not see each other."""
    of, at = _places(np.array([len(t) for t in texts], np.int64))
    gap = np.full(SIDE, OUTSIDE, np.uint8).tobytes()
    line = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.int64)
    return np.stack([line[at + o] for o in OFFSETS]), line[at], of


def fine_line(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fine codes of a line of all texts, places of their words in it), in the order of ``windows``."""
    _, at = _places(np.array([len(t) // 4 for t in texts], np.int64))
    gap = bytes(4 * SIDE)
    return np.frombuffer(gap + gap.join(texts) + gap, np.int32).astype(np.int64), at


def _cuts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(neighbours, words, line of fine codes, places of words, text number, texts) of 256 rows at a time."""
    for at in range(0, batch.num_rows, 256):
        texts = batch.column("codes").slice(at, 256).to_pylist()
        near, words, of = windows(texts)
        yield near, words, *fine_line(batch.column("fine").slice(at, 256).to_pylist()), of, len(texts)


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weighted blocks by block."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k, seen, v in zip(*[batch.column(c).to_pylist() for c in ("k", "seen", "v")]):
            total = sums.setdefault(k, [0, 0.0])
            total[0], total[1] = total[0] + seen, total[1] + np.frombuffer(v, np.float32).astype(np.float64) * seen
    if sums:
        rows = [(k, n, v.tobytes()) for k, (n, v) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["k", "seen", "v"])


def train(coded: DataFrame, rounds: int = ROUNDS, seed: int = 1, counts: np.ndarray | None = None) -> Network:
    """The network after ``rounds`` rounds over ``coded(id, codes, fine)``; each document trains in one of them.

    ``counts`` are those of the vocabulary's words that are no class of their own.
    """
    net = Network(seed, counts)
    size = net.size
    part = F.pmod(F.xxhash64("id", "codes"), F.lit(rounds))
    for turn in range(rounds):
        start = net.flat()

        def fit(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, seen = Network.of(start, size), 0
            squares = [np.full(p.shape, 1e-4, np.float32) for p in own.parts]
            for batch in batches:
                for near, words, line, at, _, _ in _cuts(batch):
                    for a in range(0, len(words), BATCH):
                        b = slice(a, a + BATCH)
                        own.learn(near[:, b], words[b], squares, RATE, (line, at[b]), line[at[b]])
                    seen += len(words)
            if seen:
                flat = own.flat()
                blocks = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array(np.full(len(blocks), seen)), pa.array(blocks, pa.binary())], ["k", "seen", "v"])

        share = coded.filter((part == turn) & (F.length("codes") > 0)).select("codes", "fine")
        kind = "k long, seen long, v binary"
        sums = sorted((r["k"], r["seen"], r["v"]) for r in share.mapInArrow(fit, kind).repartition("k").mapInArrow(_average, kind).collect())
        if sums:
            net = Network.of(np.round(np.concatenate([np.frombuffer(v) / seen for _, seen, v in sums]), 7).astype(np.float32), size)
    return net


def score(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, mean_log_likelihood) of every row under a network trained on all rows.

    ``log_likelihood`` is the sum over all words of a text of the logarithm of the probability of the word given its
    neighbours; it is 0, and the mean null, for null and empty texts and texts without words.  Rows with a null id and
    repeated rows are trained on and scored like others; an empty table gives an empty result.
    """
    vocabulary = frequent_words(df, text)
    coded, size = written(encode(df, vocabulary, id, text)), len(vocabulary.counts)
    flat = train(coded, counts=vocabulary.counts).flat()

    def make():
        net = Network.of(flat, size)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            total = []
            for near, words, line, at, of, n in _cuts(batch):
                cuts = [slice(a, a + SCORED) for a in range(0, len(words), SCORED)]
                logs = [net.log_probabilities(near[:, b], words[b], [line.take(at[b] + o) for o in OFFSETS], line[at[b]]) for b in cuts]
                total.append(np.bincount(of, weights=np.concatenate(logs) if logs else None, minlength=n).astype(np.float64))
            return [pa.array(np.concatenate(total) + batch.column("spelt").to_numpy())]

        return work

    coded = coded.withColumn("n", F.length("codes").cast("long"))
    scored = append_columns(coded, {c: c for c in ("codes", "fine", "spelt")}, {"log_likelihood": "double"}, make, keep=["id", "n"])
    mean = F.when(F.col("n") > 0, F.col("log_likelihood") / F.col("n"))
    return scored.select(F.col("id").alias(id), F.col("n").alias("n_words"), "log_likelihood", mean.alias("mean_log_likelihood"))
