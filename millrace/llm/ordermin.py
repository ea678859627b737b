"""Order MinHash fingerprints: signatures that follow edit distance, from column expressions alone.

A text is a sequence of words and its k-mers are runs of ``WIDTH`` words.  A k-mer's second, third, ... occurrence is an
element of its own.  A hash deals all (k-mer, occurrence) pairs of a text into ``SLOTS`` slots, and in each slot the
``KEEP`` pairs of smallest hash are selected, put back into text order, and hashed as a tuple of k-mers.  A slot of two
texts agrees when both selected the same k-mers *in the same order*, so moving text around lowers the likeness although
the set of k-mers stays, and the occurrence numbers make repeated passages count.

All arrays are bound to lambda variables, so each is computed once per text, and every step is linear in the text but
for two sorts.  Words are the unit because k-mers of single characters cost six times as much for the same texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.sharding import position
from millrace.llm.words import WORD

WIDTH, KEEP, SLOTS = 2, 2, 64
#: Low bits of a packed number that hold a place in the text; words beyond 2**PLACE_BITS do not occur in a string.
PLACE_BITS = 28
#: Hexadecimal digits of a slot in the fingerprint text.
SLOT_DIGITS = 4
EMPTY = "-" * SLOT_DIGITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(count: Column) -> Column:
    """0 .. count - 1, or nothing."""
    return F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _runs(starts: Column, total: Column) -> Column:
    """(first, length) of each run, from the places where runs start."""
    return let(starts, lambda at: F.transform(at, lambda s, i: F.struct(s.alias("first"), (F.coalesce(F.get(at, i + 1), total) - s).alias("many"))))


def _low(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def _high(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _packed(high: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(high, PLACE_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _starts(items: Column, of: Callable[[Column], Column]) -> Column:
    """Places in a sorted array where ``of`` differs from the element before."""
    return F.filter(_places(F.size(items)), lambda j: (j == 0) | (of(F.get(items, j)) != of(F.get(items, j - 1))))


def kmers(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of ``width`` words, in text order; a shorter text is one run, a text without words none."""

    def of(words: Column) -> Column:
        n = F.size(words)
        joined = F.transform(_places(n - width + 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
        return F.when(n >= width, joined).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(joined)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), of)


def signature(text: Column, width: int = WIDTH, keep: int = KEEP, slots: int = SLOTS) -> Column:
    """Array of ``slots`` tuple hashes; null in slots that no k-mer falls into.  Equal texts have equal signatures."""

    def numbered(found: Column) -> Column:
        """hash(k-mer, occurrence) with the place in the low bits, sorted."""

        def by_kmer(items: Column) -> Column:
            runs = _runs(_starts(items, _high), F.size(items))
            each = F.transform(
                runs,
                lambda run: F.transform(
                    F.sequence(F.lit(0), run["many"] - 1),
                    lambda o: _packed(F.xxhash64(_high(F.get(items, run["first"])), o), _low(F.get(items, run["first"] + o))),
                ),
            )
            return F.flatten(each)

        return F.sort_array(let(F.sort_array(F.transform(found, _packed)), by_kmer))

    # slots are equal intervals of the hash, so the slots of sorted pairs follow one another
    def slot(packed: Column) -> Column:
        return F.shiftright(packed, 64 - (slots.bit_length() - 1)) + slots // 2

    def select(found: Column) -> Column:
        def of(items: Column) -> Column:
            starts = _starts(items, slot)
            tuples = F.transform(_runs(starts, F.size(items)), lambda run: F.struct(slot(F.get(items, run["first"])).cast("int").alias("slot"), ordered(items, run).alias("hash")))
            return let(F.map_from_entries(tuples), lambda by: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: by[s]))

        def ordered(items: Column, run: Column) -> Column:
            places = F.sort_array(F.transform(F.slice(items, run["first"] + 1, F.least(run["many"], F.lit(keep))), _low))
            return F.xxhash64(F.transform(places, lambda p: F.get(found, p.cast("int"))))

        return let(numbered(found), of)

    return let(kmers(text, width), select)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among the slots that either signature fills; 1 if both are empty."""

    def of(pairs: Column) -> Column:
        either = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
        equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
        return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)

    return let(F.arrays_zip(a.alias("x"), b.alias("y")), of)


def fingerprint(signed: Column) -> Column:
    """A signature as text, ``SLOT_DIGITS`` hexadecimal digits per slot and dashes for an empty one."""
    mask = F.lit((1 << (4 * SLOT_DIGITS)) - 1).cast("long")
    return F.array_join(F.transform(signed, lambda h: F.coalesce(F.lpad(F.hex(h.bitwiseAND(mask)), SLOT_DIGITS, "0"), F.lit(EMPTY))), "")


def _ranges(df: DataFrame, id: str, pieces: int) -> list[int]:
    """Ids that cut the table into about equal ranges."""
    wanted = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(id, wanted, 10 * pieces).alias("p")).first()["p"] if wanted else None
    return sorted(set(found or []))


def with_next(df: DataFrame, columns: dict[str, Column], id: str = "id") -> DataFrame:
    """``df`` with the values ``columns`` of the following row in descending id; the first row follows the last.

    Ties are ordered by text hash and text, null ids come last; the only row of a table follows itself.  Ids are cut
    into ranges by quantiles, and the first row of each range is also sent to the range before it, so a window inside
    a range sees every successor: one exchange, and no task with more than a range.
    """
    spark = df.sparkSession
    pieces = min(4096, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _ranges(df.select(id), id, pieces)
    # ranges are numbered in descending order of id, with null ids in one of their own
    last = len(bounds) + 1
    part = F.when(F.col(id).isNull(), F.lit(last)).otherwise(F.lit(last - 1) - position(bounds, F.col(id)) if bounds else F.lit(0))
    tie = F.xxhash64(F.col("text"))
    placed = df.withColumn("_part", part)
    heads = {r["_part"]: (r["head"][0], r["head"][1]) for r in placed.groupBy("_part").agg(F.min(F.struct((-F.col(id)).alias("i"), tie.alias("t"))).alias("head")).collect()}
    full = sorted(heads)
    if not full:
        return placed.drop("_part").select("*", *[c.alias(n) for n, c in columns.items()])
    before = {p: full[i - 1] for i, p in enumerate(full)}
    table = spark.createDataFrame([(p, heads[p][0], heads[p][1], before[p]) for p in full], "_part int, _i long, _t long, _before int")
    marked = placed.withColumn("_tie", tie).join(F.broadcast(table), "_part")
    is_head = (-F.col(id)).eqNullSafe(F.col("_i")) & (F.col("_tie") == F.col("_t"))
    own = F.struct(F.col("_part").alias("to"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("_before").alias("to"), F.lit(1).alias("ghost"))
    sent = marked.withColumn("_sent", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))))
    order = Window.partitionBy("_sent.to").orderBy("_sent.ghost", F.desc_nulls_last(id), "_tie", "text")
    out = sent.select("*", *[F.lead(c).over(order).alias(n) for n, c in columns.items()])
    return out.filter("_sent.ghost = 0").drop("_part", "_i", "_t", "_before", "_tie", "_sent")


def edited_fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, keep: int = KEEP, slots: int = SLOTS) -> DataFrame:
    """Fingerprints of every text and of an edited version, with their likeness to each other and to the next text.

    The edited version replaces the last third (rounded down, in code points) by as many code points from the start of
    the next text in descending id (all of them if it is shorter); the first follows the last.  Returns (id, n_chars,
    edited, signature, edited_signature, near_edited, near_next).  Null and empty texts are empty, have empty
    signatures, and are fully like each other; rows of equal id are ordered by text, null ids come last.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = rows.withColumn("signature", signature(F.col("text"), width, keep, slots))
    chained = with_next(signed, {"next_text": F.col("text"), "next_signature": F.col("signature")})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    chained = chained.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signature", "next_signature")
    chained = chained.withColumn("edited_signature", signature(F.col("edited"), width, keep, slots))
    return chained.select(
        F.col("id").alias(id), "n_chars", "edited", "signature", "edited_signature",
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
