"""Similarity join of documents on word n-grams: rare-first prefix filtering, exact for every pair of texts.

A text is its set of distinct n-grams.  With grams in one order common to all texts, two sets with enough overlap share
a gram among the first few of each: the prefix.  Rare grams come first in the order, so few texts share a prefix gram.

1. *Who can have a partner.*  Under the order of hashes, linked texts share several grams of slightly longer prefixes.
   Only texts with so many shared prefix grams go on; no pair is formed, grams are counted.
2. *Order.*  The grams of those texts are counted exactly and ordered by count.  Grams of one text come first in its
   prefix and can match nothing; only shared ones become rows (gram, text, position).
3. *Length and position.*  A row allows partners up to a size that follows from the grams left behind its position;
   rows of a gram that no other text's size agrees with go.
4. *Pairs with leaders.*  All texts of a prefix gram are compared with one of them, its leader: length and position,
   then the suffix filter (differences of gram counts between fixed pivots bound the symmetric difference from below),
   then the full sets, once per pair.
5. *The other pairs.*  Let D(x) be the symmetric difference of x and the leader.  The symmetric difference of x and y is
   that of D(x) and D(y).  If x is not linked with the leader, a y linked with x must share elements of D with it, at
   least ``(|D(x)| + |D(y)| - t (|x| + |y|)) / 2`` for the largest share t of elements that a link may leave unshared.
   So texts of one gram that are not yet in one component are joined on rare-first prefixes of D, with the same
   position filter.  Texts already in one component need no further pair, so a group of copies is not expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.words import chunks, shingle_sets
from millrace.session import settle, written

#: The first step counts one gram in so many of a set besides its prefix.
EXTRA = 10
#: Keys of rows are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_KEYS = 500_000
#: Pairs of one leader that meet its set in one task; a leader's set is repeated for every further such number.
PAIRS_TOGETHER = 1024
#: Counts of grams that are told apart in the order.
MOST = 1 << 16
#: Stands for all grams that only a leader has; larger than any other number, so it comes last among equal counts.
LONE = (1 << 63) - 1
#: Grams between two pivots of the suffix filter, and the most pivots.
PIVOT_GRAMS, MOST_PIVOTS = 4, 1024


def text_class(text: Column) -> Column:
    """Key of a text: equal for exact copies only."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def least_overlap(n: Column, percent: int) -> Column:
    """Grams that a set of n shares at least with any partner."""
    return F.ceil(percent * n / 100)


def enough(shared: Column, total: Column, percent: int) -> Column:
    """Whether ``shared`` common grams of two sets of ``total`` grams together reach the threshold."""
    return (100 + percent) * shared >= percent * total


def _longs(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), flat)


def _hash_prefixes(texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, class, n, prefix) of every row: set size, and the prefix of the first step in order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = shingle_sets(part.column("text"), width)
            n = [len(s) for s in sets]
            prefix = [s[: m - (percent * m + 99) // 100 + max(1, m // EXTRA)] for s, m in zip(sets, n)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("class"), pa.array(n, pa.int64()), _longs(prefix)], ["id", "class", "n", "prefix"])

    return texts.mapInArrow(run, "id long, class binary, n long, prefix array<bigint>")


def _grams(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, grams): full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), _longs(shingle_sets(part.column("text"), width))], ["node", "n", "grams"])

    return texts.select("node", "n", "text").mapInArrow(run, "node long, n long, grams array<bigint>")


def _small(keys: DataFrame) -> DataFrame:
    """``keys``, settled, to be broadcast if they are few."""
    keys = settle(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def counted(rows: DataFrame) -> DataFrame:
    """Rows of ``rows(gram, node)`` whose gram occurs more than once, with the ``count``; higher counts than MOST are MOST.

    One exchange: rows sorted by gram stream through tasks that hold at most MOST rows of a gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full_gram = None, None

        def emit(rows: pa.RecordBatch) -> pa.RecordBatch:
            gram = rows.column("gram").to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            many = np.diff(np.concatenate([start, [len(gram)]]))
            if full_gram is not None:
                many = np.where(gram[start] == full_gram, MOST, many)
            many = np.repeat(np.minimum(many, MOST), np.diff(np.concatenate([start, [len(gram)]])))
            at = pa.array(np.flatnonzero(many > 1))
            return pa.RecordBatch.from_arrays([rows.column("gram").take(at), rows.column("node").take(at), pa.array(many[many > 1])], ["gram", "node", "count"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            gram = rows.column("gram").to_numpy(zero_copy_only=False)
            tail, last = int(np.searchsorted(gram, gram[-1], side="left")), gram[-1]
            if tail:
                yield emit(rows.slice(0, tail))
            held = rows.slice(tail)
            full_gram = full_gram if full_gram == last else None
            if held.num_rows >= MOST or full_gram is not None:
                full_gram = last
                yield emit(held)
                held = None
        if held is not None and held.num_rows:
            yield emit(held)

    return rows.select("gram", "node").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "gram long, node long, count long")


def pivot_counts(grams: np.ndarray, n: int) -> np.ndarray:
    """Grams between each two of the pivots that a set of n grams uses; pivots halve with the low bits of a gram."""
    pivots = 1 << max(0, min(MOST_PIVOTS.bit_length() - 1, (max(n, 1) // PIVOT_GRAMS).bit_length() - 1))
    return np.bincount(grams & (pivots - 1), minlength=pivots).astype(np.uint32)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets from their counts between pivots."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    pivots = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, pivots).sum(axis=0) - y.reshape(-1, pivots).sum(axis=0)).sum())


class _Join:
    """Sets of the texts that can have a partner: ``sets(node, n, alone, grams)``, grams rare first without the lone ones."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy(zero_copy_only=False)
                lists = batch.column("grams")
                counts = [pivot_counts(lists[i].values.to_numpy(zero_copy_only=False), int(m)).tobytes() for i, m in enumerate(n)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("alone"), pa.array(counts, pa.binary())], ["node", "n", "alone", "counts"])

        self.pivots = written(sets.mapInArrow(run, "node long, n long, alone long, counts binary"))

    def repeated(self, pairs: DataFrame, table: DataFrame, on: str, columns: dict[str, str]) -> DataFrame:
        """``pairs`` with columns of ``table`` for its node ``on``; the row of a node in very many pairs is repeated."""
        full = settle(pairs.groupBy(on).count().filter(F.col("count") > PAIRS_TOGETHER).select(on, F.ceil(F.col("count") / PAIRS_TOGETHER).cast("int").alias("_of")))
        table = table.select(F.col("node").alias(on), *[F.col(c).alias(a) for c, a in columns.items()])
        if not full.take(1):
            return pairs.join(table, on)
        full = F.broadcast(full) if full.count() <= BROADCAST_KEYS else full
        rows = table.join(full, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1))).drop("_of")
        other = "b" if on == "a" else "a"
        salted = pairs.join(full, on, "left").withColumn("_salt", F.pmod(F.xxhash64(other), F.coalesce("_of", F.lit(1))).cast("int")).drop("_of")
        return salted.join(rows, [on, "_salt"]).drop("_salt")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b), a < b, whose sets reach the threshold."""
        percent = self.percent
        for x in "ab":
            pairs = self.repeated(pairs, self.pivots, x, {"n": f"n{x}", "alone": f"alone{x}", "counts": f"counts{x}"})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = (np.asarray(batch.column("na")) + np.asarray(batch.column("nb"))).astype(np.int64)
                lone = (np.asarray(batch.column("alonea")) + np.asarray(batch.column("aloneb"))).astype(np.int64)
                both = zip(batch.column("countsa").to_pylist(), batch.column("countsb").to_pylist())
                differ = lone + np.fromiter((least_difference(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in both), np.int64, len(lone))
                stay = pa.array((100 + percent) * differ <= (100 - percent) * total)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(stay), batch.column("b").filter(stay), pa.array(total).filter(stay)], ["a", "b", "total"])

        close = settle(pairs.mapInArrow(run, "a long, b long, total long"))
        for x in "ab":
            close = self.repeated(close, self.sets, x, {"grams": f"grams{x}"})
        shared = F.size(F.array_intersect("gramsa", "gramsb")).cast("long")
        return settle(close.filter(enough(shared, F.col("total"), percent)).select("a", "b"))

    def postings(self) -> DataFrame:
        """(gram, node, n, left): shared prefix grams, with the grams from each to the end of its set; some other text allows each row."""
        p = self.percent
        length = (F.col("n") - least_overlap(F.col("n"), p) + 1 - F.col("alone")).cast("int")
        rows = self.sets.filter(length > 0).select("node", "n", "alone", F.posexplode(F.slice("grams", F.lit(1), length)).alias("at", "gram"))
        left = F.col("n") - F.col("alone") - F.col("at")
        most = F.least(F.floor((100 + p) * left / p) - F.col("n"), F.floor(100 * F.col("n") / p))
        rows = settle(rows.select("gram", "node", "n", left.alias("left"), most.alias("most")))
        kinds = rows.groupBy("gram").agg(F.count("*").alias("many"), F.min("n").alias("least"), F.max("most").alias("largest")).filter("many > 1")
        rows = rows.join(kinds, "gram").filter("most >= least and n <= largest")
        kinds = rows.groupBy("gram").agg(F.count("*").alias("many")).filter("many > 1")
        return settle(rows.select("gram", "node", "n", "left").join(kinds, "gram"))

    def leaders(self, rows: DataFrame) -> DataFrame:
        """(gram, leader, leader_n, leader_left): the text of each gram whose other grams are fullest."""
        ranked = rows.join(rows.groupBy("node").agg(F.sum("many").alias("rank")), "node")
        top = ranked.groupBy("gram").agg(F.max(F.struct("rank", (-F.col("node")).alias("less"), "n", "left")).alias("top"))
        return settle(top.select("gram", (-F.col("top.less")).alias("leader"), F.col("top.n").alias("leader_n"), F.col("top.left").alias("leader_left")))

    def with_leaders(self, rows: DataFrame, leaders: DataFrame) -> DataFrame:
        """Pairs (a, b) of a text and a leader that length and position allow."""
        led = rows.join(leaders, "gram").filter("node != leader")
        before = F.least(F.col("n") - F.col("left"), F.col("leader_n") - F.col("leader_left"))
        fits = enough(before + F.least("left", "leader_left"), F.col("n") + F.col("leader_n"), self.percent)
        lengths = 100 * F.least("n", "leader_n") >= self.percent * F.greatest("n", "leader_n")
        return led.filter(fits & lengths).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    def differences(self, around: DataFrame) -> DataFrame:
        """(leader, node, component, far, n, size, apart, lone): the elements of D(node) that another D may hold.

        ``size`` counts all elements, lone grams too.  ``lone`` is the number of lone grams of the leader, which every D
        holds; one element ``LONE`` of ``apart`` stands for them.  ``far`` tells texts outside the leader's component.
        """
        pairs = around.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), "component", "far")
        pairs = self.repeated(pairs, self.sets, "b", {"n": "n", "alone": "alone", "grams": "grams"})
        pairs = self.repeated(pairs, self.sets, "a", {"alone": "lone", "grams": "lead"})
        apart = F.concat(F.array_except("grams", "lead"), F.array_except("lead", "grams"))
        size = F.size(apart) + F.col("alone") + F.col("lone")
        apart = F.when(F.col("lone") > 0, F.concat(apart, F.array(F.lit(LONE)))).otherwise(apart)
        return written(pairs.select(F.col("a").alias("leader"), F.col("b").alias("node"), "component", "far", "n", size.alias("size"), apart.alias("apart"), "lone"))

    def others(self, rows: DataFrame, leaders: DataFrame, component: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components around one leader, with an element of D in common in place to link them."""
        p = self.percent
        component = component.withColumnRenamed("component", "_component")
        grouped = rows.select("gram", "node").join(component, "node", "left").select("gram", "node", F.coalesce("_component", "node").alias("component"))
        open_grams = grouped.groupBy("gram").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("many")).filter("c0 < c1 and many > 2")
        open_grams = open_grams.join(leaders, "gram").join(component.withColumnRenamed("node", "leader"), "leader", "left")
        open_grams = open_grams.select("gram", "leader", F.coalesce("_component", "leader").alias("lead_component"))
        around = grouped.join(open_grams, "gram").select("leader", "node", "component", (F.col("component") != F.col("lead_component")).alias("far")).distinct()
        parts = self.differences(settle(around))
        # need(x) + need(y), in units of 1 / (200 + 2 p), is the number of common elements of a linked pair
        need = (100 + p) * F.col("size") - (100 - p) * F.col("n")
        limits = parts.groupBy("leader").agg(F.min(need).alias("least"), F.min(F.when(F.col("far"), need)).alias("least_far")).filter("least_far is not null")
        more = F.greatest(F.col("lone") - 1, F.lit(0))  # grams behind the one that stands for them
        possible = 2 * (100 + p) * (F.size("apart") + more) - need >= F.when(F.col("far"), F.col("least")).otherwise(F.col("least_far"))
        elements = parts.join(limits, "leader").filter(possible).select("leader", "node", "component", "far", need.alias("need"), more.alias("more"), F.explode("apart").alias("gram"))
        kinds = elements.groupBy("leader", "gram").agg(F.count("*").alias("times"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.max("far").alias("far_any"))
        kinds = kinds.filter("c0 < c1 and far_any").select("leader", "gram", "times")
        ordered = elements.join(kinds, ["leader", "gram"]).groupBy("leader", "node", "component", "far", "need", "more").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("list"))
        placed = ordered.select("leader", "node", "component", "far", "need", "more", F.size("list").alias("many"), F.posexplode("list").alias("at", "item"))
        room = 2 * (100 + p) * (F.col("many") - F.col("at") + F.col("more")) - F.col("need")
        placed = placed.select("leader", "node", "component", "far", "need", room.alias("room"), F.col("item.gram").alias("gram"))
        placed = settle(placed.join(limits, "leader").filter(F.col("room") >= F.when(F.col("far"), F.col("least")).otherwise(F.col("least_far"))).drop("least", "least_far"))
        kinds = placed.groupBy("leader", "gram").agg(F.min("need").alias("least"), F.min(F.when(F.col("far"), F.col("need"))).alias("least_far"), F.max("room").alias("most"), F.min("component").alias("c0"), F.max("component").alias("c1"))
        kinds = kinds.filter("c0 < c1 and least_far is not null").drop("c0", "c1")
        placed = placed.join(kinds, ["leader", "gram"]).filter((F.col("room") >= F.when(F.col("far"), F.col("least")).otherwise(F.col("least_far"))) & (F.col("need") <= F.col("most")))
        placed = settle(placed.select("leader", "gram", "node", "component", "far", "need", "room"))
        mates = placed.select("leader", "gram", *[F.col(c).alias(f"{c}_") for c in ("node", "component", "far", "need", "room")])
        once = ~F.col("far_") | (F.col("node") < F.col("node_"))
        fits = once & (F.col("component") != F.col("component_")) & (F.col("need_") <= F.col("room")) & (F.col("need") <= F.col("room_"))
        return placed.filter("far").join(mates, ["leader", "gram"]).filter(fits).select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()


def _sets(texts: DataFrame, classes: DataFrame, marked: DataFrame, percent: int, width: int) -> DataFrame:
    """(node, n, alone, grams) of the texts that can have a partner."""
    spread = marked.join(_small(classes.select("row", "node", "n")), "row").select("node", F.explode("prefix").alias("gram"))
    found = counted(spread).groupBy("node").agg(F.count("*").alias("found"))
    least = F.greatest(F.lit(1), F.floor(least_overlap(F.col("n"), percent) / EXTRA))
    alive = settle(classes.join(found, "node").filter(F.col("found") >= least).select("class", F.col("id").alias("first"), "node", "n"))
    keys = _small(alive.select("class", "first", "node", "n"))
    rows = texts.join(keys, (texts["class"] == keys["class"]) & texts["id"].eqNullSafe(keys["first"])).select("node", "n", "text")
    grams = written(_grams(rows, width))
    if grams.count() > alive.count():  # a text repeated under one id came more than once
        grams = grams.dropDuplicates(["node"])
    shared = counted(grams.select("node", F.explode("grams").alias("gram")))
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "gram"))).alias("list")).join(alive.select("node", "n"), "node")
    lists = lists.filter(F.size("list") >= least_overlap(F.col("n"), percent))
    return written(lists.select("node", "n", (F.col("n") - F.size("list")).alias("alone"), F.col("list.gram").alias("grams")))


def similar_texts(df: DataFrame, percent: int = 80, width: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: set size, and the smallest id reachable over links.

    Texts are linked when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``width``-word shingles
    (ASCII lower case, words between ASCII white space; fewer words are one shingle).  Null texts and texts without
    words have an empty set and are linked with nothing.  Exact copies are one text.  Rows with a null id are linked by
    their texts, too: the component is the smallest id that is not null, or null if there is none.  Several texts under
    one id are taken each by itself.  Other columns of any name are ignored; an empty table gives an empty result.
    """
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("class", text_class(F.col("text")))
    marked = written(_hash_prefixes(texts, percent, width).withColumn("row", F.monotonically_increasing_id()))
    classes = marked.filter("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.max("n").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    join = _Join(_sets(texts, classes, marked, percent, width), percent)
    rows = join.postings()
    leaders = join.leaders(rows)
    tested = settle(join.with_leaders(rows, leaders))
    links = join.linked(tested)
    found = settle(components(links))
    late = join.linked(settle(join.others(rows, leaders, found).join(tested, ["a", "b"], "left_anti")))
    final = components(links.union(late)) if late.take(1) else found

    named = classes.join(final, "node", "left").select("class", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("class", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return marked.join(named, "class", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), own.alias("component_id"))
