"""Near-duplicate documents: banded MinHash candidates, odd sketches, exact confirmation.

1. Each text becomes its set of 64-bit shingle hashes, its MinHash samples, a key per band of samples, and an *odd
   sketch*: sample ``i`` with value ``h`` flips bit ``hash(i, h)`` of a bitmap, so a bit is set when an odd number of
   samples met in it.  XOR of two bitmaps leaves the samples in which two texts differ, and with ``x`` bits set of
   ``n`` after ``k`` samples the similarity is about ``1 + n / (4 k) * ln(1 - 2 x / n)``.
2. Texts that share a band key are candidates.  A bucket is not expanded into pairs: all its members are compared with
   one leader, the member whose other buckets are fullest, which in a group of edited copies is the text they were
   edited from.  Once the links so found are closed into components, only buckets that still hold several components
   are looked at again, and only for pairs of different components: either the counts of shingles shared with the
   leader leave a link possible, or the pair has a shingle in common that the leader lacks.  Nothing that could join
   two components is left out, and no group is expanded into all its pairs.
3. Candidates whose sketches speak clearly against the threshold are dropped; the others are confirmed on full sets.

Exact copies share one class and are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.words import chunks, mix, odd_numbers, shingle_sets
from millrace.session import settle, written

#: Samples per band, and the chance that a pair exactly at the threshold shares no band.
ROWS, MISS = 5, 1e-6
SKETCH_BITS = 512
#: Sketches drop a pair only this many standard deviations below the threshold.
DOUBT = 5.0
#: Ids of texts to confirm are broadcast up to this many (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 500_000


def bands_for(percent: int) -> int:
    """Bands that find a pair at the threshold but for a chance of ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS)))


def minhash(grams: np.ndarray, samples: int) -> np.ndarray:
    """The smallest value of the set under each of ``samples`` permutations of 64-bit words."""
    a, b = odd_numbers(samples, 11), odd_numbers(samples, 23)
    least = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048, None] * a + b
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of MinHash samples as 64-bit words."""
    at = mix(samples + odd_numbers(len(samples), 41)) % np.uint64(bits)
    parity = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64)


def sketch_similarity(differing: float, samples: int, bits: int = SKETCH_BITS) -> float:
    """Estimated similarity of two sets whose sketches differ in ``differing`` bits."""
    return 1 + bits / (4 * samples) * math.log(max(1 - 2 * differing / bits, 1e-9))


def most_differing_bits(percent: int, samples: int, bits: int = SKETCH_BITS) -> int:
    """Differing bits up to which a pair may still reach the threshold."""
    j = percent / 100
    low = j - DOUBT * math.sqrt(j * (1 - j) / samples) - DOUBT / math.sqrt(bits) / 4
    return max(x for x in range(bits) if sketch_similarity(x, samples, bits) >= low)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), flat)


def signatures(df: DataFrame, bands: int, width: int = 5) -> DataFrame:
    """(id, class, n, bands, sketch) of each row of ``df(id, class, text)``; one pass over the texts, no shuffle."""
    samples = bands * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, base = odd_numbers(ROWS, 5), odd_numbers(bands, 61)
        for part in chunks(batches):
            sets = shingle_sets(part.column("text"), width)
            keys, sketches = [], []
            for grams in sets:
                least = minhash(grams, samples)
                keys.append(mix((least.reshape(bands, ROWS) * weight).sum(axis=1, dtype=np.uint64) + base) if len(grams) else least[:0])
                sketches.append(odd_sketch(least) if len(grams) else least[:0])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("class"), pa.array([len(s) for s in sets], pa.int64()), _longs(keys), _longs(sketches)],
                ["id", "class", "n", "bands", "sketch"],
            )

    return df.select("id", "class", "text").mapInArrow(run, "id long, class binary, n long, bands array<bigint>, sketch array<bigint>")


def gram_sets(df: DataFrame, width: int = 5) -> DataFrame:
    """(id, grams): full sets of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("id"), _longs(shingle_sets(part.column("text"), width))], ["id", "grams"])

    return df.select("id", "text").mapInArrow(run, "id long, grams array<bigint>")


def _differing(x: str, y: str) -> Column:
    words = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_BITS // 64)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total


class _Search:
    """What the two rounds of candidates share."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, percent: int, bands: int, width: int):
        self.texts, self.nodes, self.percent, self.width = texts, nodes, percent, width
        self.most = most_differing_bits(percent, bands * ROWS)

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and sketches leave the threshold possible."""
        side = self.nodes.select("id", "n", "sketch")
        for x in "ab":
            pairs = pairs.join(side.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")), x)
        return pairs.filter(self.possible("na", "nb", "sa", "sb")).select("a", "b")

    def possible(self, na: str, nb: str, sa: str, sb: str) -> Column:
        return (100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)) & (_differing(sa, sb) <= self.most)

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, grams) of the given texts, each from one of its rows."""
        wanted = settle(self.nodes.select("id", "class", "first").join(ids.distinct(), "id").toDF("_id", "_class", "_first"))
        many = wanted.count()
        wanted = F.broadcast(wanted) if many <= BROADCAST_IDS else wanted
        rows = self.texts.join(wanted, (F.col("class") == F.col("_class")) & F.col("id").eqNullSafe(F.col("_first")))
        found = written(gram_sets(rows.select(F.col("_id").alias("id"), "text"), self.width))
        return found if found.count() == many else found.dropDuplicates(["id"])  # a row may be repeated

    def enough(self, shared: Column, n: Column, m: Column) -> Column:
        """Whether ``shared`` common shingles of sets of n and m reach the threshold."""
        return (100 + self.percent) * shared >= self.percent * (n + m)

    def around_leaders(self, around: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components around one leader that may reach the threshold.

        ``around(leader, id, component)``.  With ``own`` the shingles of a text that its leader lacks and ``in`` the
        number of the others, two texts share at most ``min(in, in')`` shingles of the leader besides those of both
        ``own`` sets.  So a pair either has few enough shingles for ``min(in, in')`` to be enough, which depends on
        counts alone, or has an ``own`` shingle in common, which few texts do.  Of the sorted ``own`` shingles only
        as many can be the first common one as leave the number still needed after it.
        """
        sets = self.sets(around.select("id").union(around.select("leader")))
        full = around.filter("id != leader").join(sets, "id").join(sets.select(F.col("id").alias("leader"), F.col("grams").alias("lead")), "leader")
        own = F.array_sort(F.array_except("grams", "lead"))
        full = full.select("leader", "id", "component", F.size("grams").cast("long").alias("n"), own.alias("own"))
        full = written(full.withColumn("in", F.col("n") - F.size("own")))
        tops = full.groupBy("leader", "component").count().groupBy("leader").agg(F.max(F.struct("count", "component")).alias("top"))
        kinds = full.groupBy("leader").agg(F.min("n").alias("least"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1")
        tops = kinds.join(tops, "leader").select("leader", "least", F.col("top.component").alias("top"))
        full = full.join(tops, "leader")
        narrow = settle(full.select("leader", "id", "component", "top", "n", "in"))
        other = narrow.drop("top").toDF("leader_", "id_", "component_", "n_", "in_")
        differ = (F.col("leader") == F.col("leader_")) & (F.col("component") != F.col("component_"))

        sizes = narrow.select(F.col("leader").alias("leader_"), F.col("n").alias("n_")).distinct()
        rest = narrow.filter("component != top")
        close = self.enough(F.col("in"), F.col("n"), F.col("n_")) & (100 * F.least("n", "n_") >= self.percent * F.greatest("n", "n_"))
        by_size = rest.join(sizes, (F.col("leader") == F.col("leader_")) & close).drop("leader_")
        by_count = by_size.join(other.withColumnRenamed("n_", "m_"), differ & (F.col("n_") == F.col("m_")) & self.enough(F.col("in_"), F.col("n"), F.col("n_")))

        least = F.greatest("least", F.ceil(self.percent * F.col("n") / 100))
        wanted = F.greatest(F.lit(1), F.ceil(self.percent * (F.col("n") + least) / (100 + self.percent)) - F.col("in"))
        heads = full.withColumn("head", F.size("own") - wanted + 1).filter("head > 0")
        heads = heads.select("leader", "id", "component", "top", "n", F.explode(F.slice("own", F.lit(1), F.col("head").cast("int"))).alias("gram"))
        shared = heads.groupBy("leader", "gram").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1")
        heads = settle(heads.join(shared.select("leader", "gram"), ["leader", "gram"]))
        mates = heads.select(*[F.col(c).alias(f"{c}_") for c in ("leader", "id", "component", "n", "gram")])
        ratio = 100 * F.least("n", "n_") >= self.percent * F.greatest("n", "n_")
        by_gram = heads.filter("component != top").join(mates, differ & (F.col("gram") == F.col("gram_")) & ratio)
        pairs = [x.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")) for x in (by_count, by_gram)]
        return settle(pairs[0].union(pairs[1]).distinct())

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        sets = self.sets(pairs.select("a").union(pairs.select("b")).withColumnRenamed("a", "id"))
        for x in "ab":
            pairs = pairs.join(sets.select(F.col("id").alias(x), F.col("grams").alias(f"g{x}")), x)
        both = F.size(F.array_intersect("ga", "gb")).cast("long")
        sized = pairs.select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb")).cast("long").alias("sum"))
        return sized.filter(self.enough(F.col("both"), F.col("sum"), F.lit(0))).select("a", "b").distinct()


def text_class(text: Column) -> Column:
    """Key of a text: equal for exact copies only."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def drop_near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near copies: that of the smallest id, all columns as they are.

    Unlike texts under one id are groups of their own, and each stays.  Of repeated rows (equal id and text) one stays.
    Rows without an id come after all others of their group.  Texts without words are like nothing and stay once per id
    and text.  Texts move only if more rows go than fit a broadcast, or where rows repeat one another.
    """
    marked = written(near_duplicates(df, percent, width, id, text).select(F.col(id).alias("id"), "class", "group"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "class")).alias("first")
    stay = marked.filter("group is not null").groupBy("group").agg(first).select("group", F.col("first.id").alias("first_id"), F.col("first.class").alias("first_class"))
    # group ids are unique per text, so a hot group is a group of copies only
    gone = marked.join(stay, "group").filter(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("class") == F.col("first_class"))))
    gone = written(gone.select(F.col("id").alias("_gone_id"), F.col("class").alias("_gone_class")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    key = text_class(F.col(text))
    rest = df.join(gone, F.col(id).cast("long").eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_class")), "left_anti")
    again = settle(marked.groupBy("id", "class").count().filter("count > 1").select(F.col("id").alias("_again"), F.col("class").alias("_again_class")))
    if not again.take(1):
        return rest
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    repeated = F.col(id).cast("long").eqNullSafe(F.col("_again")) & (key == F.col("_again_class"))
    once = rest.withColumn("_class", key).join(again, repeated, "left_semi").dropDuplicates([id, "_class"]).drop("_class")
    return rest.join(again, repeated, "left_anti").union(once)


def near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, class, group) for every row of ``df``.

    Texts are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``width``-word shingles
    (ASCII lower case, words between ASCII white space).  ``component_id`` is the smallest id reachable over links.
    Texts that are null or without words have an empty set and are linked with nothing, not even each other.  Rows
    with a null id are linked by their texts; the component is null if no text of it has an id.  Rows that repeat an id
    are taken by their own texts.  ``kept`` tells whether a row has the id of its component.  ``class`` is the key of
    the row's text, ``group`` that of its component, null for an empty set.  Other columns of any name are ignored; an
    empty table gives an empty result.
    """
    bands = bands_for(percent)
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("class", text_class(F.col("text")))
    marked = written(signatures(texts, bands, width))
    classes = marked.filter("n > 0").groupBy("class").agg(F.min("id").alias("first"), F.max(F.struct("n", "bands", "sketch")).alias("s"))
    classes = written(classes.select("class", "first", "s.*").withColumn("id", F.monotonically_increasing_id()))
    nodes = classes.select("id", "n", "bands", "sketch")
    search = _Search(texts, classes.select("id", "class", "first", "n", "sketch"), percent, bands, width)

    spread = nodes.select("id", F.explode("bands").alias("key")).distinct()
    full = spread.groupBy("key").count().filter("count > 1")
    members = settle(spread.join(full, "key"))
    # of equally full texts the one of the smallest id leads, which is likelier to be what the others were copied from
    ranks = members.groupBy("id").agg(F.sum("count").alias("rank")).join(classes.select("id", (-F.col("first")).alias("early")), "id")
    leaders = members.join(ranks, "id").groupBy("key").agg(F.max(F.struct("rank", "early", (-F.col("id")).alias("less"))).alias("lead"))
    led = members.join(leaders.select("key", (-F.col("lead.less")).alias("leader")), "key").filter("id != leader")
    tested = settle(search.close(led.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()))
    links = settle(search.confirm(tested))
    found = settle(components(links))

    grouped = members.select("id", "key", "count").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = grouped.filter("count > 2").groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
    open_keys = open_keys.select("key").join(leaders.select("key", (-F.col("lead.less")).alias("leader")), "key")
    around = settle(grouped.join(open_keys, "key").select("leader", "id", "component").distinct())
    more = search.around_leaders(around).join(tested, ["a", "b"], "left_anti")
    late = settle(search.confirm(settle(search.close(more))))
    final = components(links.union(late)) if late.take(1) else found

    of_class = classes.select("class", "first", F.col("id").alias("node")).join(final, "node", "left").select("class", "first", F.coalesce("component", "node").alias("group"))
    least = of_class.groupBy("group").agg(F.min("first").alias("component"))
    of_class = of_class.join(least, "group").select("class", "group", "component")
    out = marked.select("id", "n", "class").join(of_class, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), "class", F.when(F.col("n") > 0, F.col("group")).alias("group"))
