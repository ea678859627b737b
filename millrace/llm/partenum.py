"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letter multisets.

A word's letters form a set of (letter, occurrence) dimensions.  One replaced letter changes two of them, one inserted
or deleted letter changes one.  The dimensions are dealt into parts of about equal weight.  Two sets that differ in at
most ``k`` dimensions agree on all but ``k`` parts, so they agree exactly on some choice of ``parts - k`` of them: a
word has one signature for every such choice, near words are equal in at least one, and an equi-join finds them.  Words
of equal length are joined with ``k = 2``, words of lengths one apart with ``k = 1``.

A signature that many words share is split once more, by the first and by the second half of the word: one edit leaves
one of the halves as it is.  Every candidate is verified by its edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix
from millrace.session import settle, written

LETTERS = r"[a-zÀ-ÿ]"
#: Parts for words of equal length (two dimensions differ) and of lengths one apart (one differs).
EQUAL_PARTS, APART_PARTS = 6, 3
#: Letters are codes below this; occurrences from ``COUNTED`` on are dealt by a hash and not by their weight.
CODES, COUNTED = 256, 4
#: Words of one signature that are compared as they are; of a fuller one only those that share a half too.
CROWD = 32


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def noisy_words(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """(word): every run of letters, lower-cased in A-Z, of at least ``least`` letters after the noise below.

    Where ``every`` divides the crc32 of ``<id>:<run>``, the letter at crc32 modulo length is deleted from the run.
    A null id counts as no characters; null and empty texts have no runs.
    """
    runs = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(LETTERS + "{%d,}" % least), F.lit(0))
    rows = df.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"), F.char_length("run").alias("n"))
    at = (F.col("h") % F.col("n")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("n")))
    return rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def dimensions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter, occurrence, first dimension of each word plus the total) of all words."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    codes = codes[np.lexsort((codes, owner))]
    start = np.ones(len(codes), bool)
    start[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(codes)), 0))
    return codes, np.arange(len(codes)) - first, bounds


def weights(words: DataFrame) -> np.ndarray:
    """How many words have each (letter, occurrence below COUNTED); one row per pair reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CODES * COUNTED, np.int64)
        for batch in batches:
            codes, nth, _ = dimensions(batch.column("word").to_pylist())
            counted = (nth < COUNTED) & (codes < CODES)
            total += np.bincount(codes[counted] * COUNTED + nth[counted], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(CODES * COUNTED, np.int64)
    for r in words.select("word").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def deal(weight: np.ndarray, parts: int) -> np.ndarray:
    """Part of each (letter, occurrence): heaviest first into the lightest part; those without weight in turn."""
    load, part = [0] * parts, np.arange(len(weight)) % parts
    for at in np.argsort(-weight, kind="stable")[: np.count_nonzero(weight)].tolist():
        lightest = min(range(parts), key=load.__getitem__)
        part[at], load[lightest] = lightest, load[lightest] + int(weight[at])
    return part


def _part_sums(words: list[str], part: np.ndarray, parts: int) -> np.ndarray:
    """Hash of each word's dimensions in each part (words x parts)."""
    codes, nth, bounds = dimensions(words)
    own = mix((codes << 32 | nth).astype(np.uint64) + np.uint64(1))
    counted = (nth < COUNTED) & (codes < CODES)
    of = np.where(counted, part[np.where(counted, codes * COUNTED + nth, 0)], (own % np.uint64(parts)).astype(np.int64))
    return np.stack([np.add.reduceat(np.where(of == p, own, np.uint64(0)), bounds[:-1]) for p in range(parts)], axis=1)


def enumerated(words: list[str], part: np.ndarray, parts: int, differing: int, tag: np.ndarray) -> np.ndarray:
    """Signatures of each word (words x choices): one for each choice of ``parts - differing`` parts, told apart by ``tag``."""
    sums = mix(_part_sums(words, part, parts) + np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for number, choice in enumerate(combinations(range(parts), parts - differing)):
        out.append(mix(sums[:, list(choice)].sum(axis=1, dtype=np.uint64) + mix((tag * 1024 + number).astype(np.uint64))))
    return np.stack(out, axis=1)


def signatures(words: DataFrame) -> DataFrame:
    """(word, key, role): every signature of every word of ``words(word)``.

    Role 0 is for partners as long as the word, 1 for partners one letter shorter, 2 for partners one letter longer.
    """
    weight = weights(words)
    equal_part, apart_part = deal(weight, EQUAL_PARTS), deal(weight, APART_PARTS)
    equal, apart = comb(EQUAL_PARTS, 2), APART_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            size = np.array([len(w) for w in words], np.int64)
            keys = [enumerated(words, equal_part, EQUAL_PARTS, 2, size), *(enumerated(words, apart_part, APART_PARTS, 1, -size - by) for by in (0, 1))]
            rows = np.concatenate(keys, axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists], ["word", "keys"])

    rows = words.select("word").mapInArrow(run, "word string, keys array<bigint>").select("word", F.posexplode("keys").alias("at", "key"))
    return rows.select("word", "key", F.when(F.col("at") < equal, 0).when(F.col("at") < equal + apart, 1).otherwise(2).alias("role"))


def _halves() -> Column:
    """The first and the second half of a word, cut where the shorter word of a pair has its middle."""
    n = F.char_length("word")
    shorter = F.when(F.col("role") == 1, n - 1).otherwise(n)
    first = F.floor(shorter / 2).cast("int")
    head = F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), first))
    return F.array(head, F.concat(F.lit(">"), F.substring(F.col("word"), (n - shorter + first + 1).cast("int"), n)))


def _one_edit(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Which rows of two code matrices (padded with 0) are one edit apart; ``a`` is as long as ``b`` or one longer."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    behind = np.arange(a.shape[1] - 1) >= first[:, None]
    shifted = ~((a[:, 1:] != b[:, :-1]) & behind).any(axis=1)
    return np.where(na == nb, differ.sum(axis=1) == 1, (na == nb + 1) & shifted)


def _pairs_of(words: pa.Array, key: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of words one edit apart among rows sorted by key."""
    out: list[np.ndarray] = []
    coded = words.dictionary_encode()
    texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    size = np.array([len(w) for w in texts], np.int64)
    by = 1
    while len(key) > by and len(i := np.flatnonzero(key[by:] == key[:-by])):
        j = i + by
        swap = role[i] > role[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        fits = ((role[i] == 0) | ((role[i] == 1) & (role[j] == 2))) & (code[i] != code[j])
        out.append(np.stack([i[fits], j[fits]], axis=1))
        by += 1
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    width = size[code[pairs]].max(axis=1, initial=0)
    good = np.zeros(len(pairs), bool)
    for at in np.unique((width + 15) // 16):  # longer words make wider matrices, so they are compared apart
        of = np.flatnonzero((width + 15) // 16 == at)
        for part in np.array_split(of, max(1, len(of) * int(at) // 16_384)):
            used, where = np.unique(code[pairs[part]], return_inverse=True)
            table = np.frombuffer("".join(texts[u].ljust(16 * int(at) + 1, "\0") for u in used.tolist()).encode("utf-32-le"), np.uint32)
            table, where = table.reshape(len(used), -1).astype(np.uint16), where.reshape(-1, 2)
            good[part] = _one_edit(table[where[:, 0]], table[where[:, 1]], size[used[where[:, 0]]], size[used[where[:, 1]]])
    return pairs[good, 0], pairs[good, 1]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, role, word) sorted by key to pairs (a, b) of small groups, and to the rows (a, key, role) of crowded ones."""
    held, open_key = None, None

    def emit(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, role, words = rows.column("key").to_numpy(zero_copy_only=False), rows.column("role").to_numpy(zero_copy_only=False), rows.column("word")
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.concatenate([start, [len(key)]]))
        full = np.repeat((many > CROWD) | (key[start] == open_key if open_key is not None else False), many)
        some = np.flatnonzero(~full & np.repeat(many > 1, many))
        small = words.take(pa.array(some))
        a, b = _pairs_of(small, key[some], role[some])
        found = pa.table({"a": small.take(pa.array(a)), "b": small.take(pa.array(b)), "key": pa.nulls(len(a), pa.int64()), "role": pa.nulls(len(a), pa.int32())})
        over = pa.array(np.flatnonzero(full))
        crowd = pa.table({"a": words.take(over), "b": pa.nulls(len(over), pa.string()), "key": rows.column("key").take(over), "role": rows.column("role").take(over)})
        for table in (found, crowd):
            yield from table.combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        key = rows.column("key").to_numpy(zero_copy_only=False)
        tail = int(np.searchsorted(key, key[-1], side="left"))
        if tail:
            yield from emit(rows.slice(0, tail))
        held, last = rows.slice(tail), key[-1]
        if open_key is not None and open_key != last:
            open_key = None
        if held.num_rows > CROWD or open_key is not None:
            open_key = last
            yield from emit(held)
            held = None
    if held is not None and held.num_rows:
        yield from emit(held)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): each pair of ``words(word)`` that differ by one inserted, deleted or replaced letter, once.

    Rows sorted by signature stream through Arrow tasks that hold one small group at a time; rows of crowded
    signatures come out again and are joined by signature and half of the word.
    """
    sorted_rows = signatures(words).repartition("key").sortWithinPartitions("key").select("key", "role", "word")
    found = written(sorted_rows.mapInArrow(_within, "a string, b string, key long, role int"))
    halves = found.filter("key is not null").select("key", "role", F.col("a").alias("word"))
    halves = halves.select("key", "role", "word", F.explode(_halves()).alias("half"))
    left = halves.select("key", "half", F.col("word").alias("a"), F.col("role").alias("role_a"))
    right = halves.select("key", "half", F.col("word").alias("b"), F.col("role").alias("role_b"))
    fits = ((F.col("role_a") == 0) & (F.col("role_b") == 0) & (F.col("a") < F.col("b"))) | ((F.col("role_a") == 1) & (F.col("role_b") == 2))
    more = left.join(right, ["key", "half"]).filter(fits & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    pairs = found.filter("key is null").select("a", "b").union(more)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from each word of ``forms(word, form)``; paths must not return.

    Every round doubles the steps already taken.
    """
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not new.filter("moved").take(1):
            return new.drop("moved")
        now = new.drop("moved")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words(word, n)``, words distinct.

    ``form`` is the near word of largest n (of several the first in code-point order) if its n is at least ``ratio``
    times the word's, else null; ``root`` is reached by following forms, and is the word itself if it has none.
    """
    pairs = settle(near_pairs(words))
    sides = pairs.union(pairs.select("b", "a")).toDF("word", "mate")
    sides = sides.join(words.select(F.col("word").alias("mate"), F.col("n").alias("m")), "mate")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "mate")).alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.mate")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, -F.col("best.less")).alias("form_n")
    )
    out = settle(out)
    out = out.join(roots(out.filter("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """``variants`` of the words of whole texts (see ``noisy_words``) that occur at least ``times`` times in all.

    Null and empty texts have no words, repeated rows count each, other columns of any name are ignored; a table
    without such words gives an empty result.
    """
    words = noisy_words(df, id, text, least, every).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)
    return variants(written(words), ratio)
