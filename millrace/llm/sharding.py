"""Sharding by histogram sort: shards of near-equal bytes that are consecutive ranges of one total order.

Rows are ordered by a hash of their text, then id, then place in the input, so equal texts are neighbours and no key
can stand for more than one row.  Splitters are found without moving rows: every pass counts the exact bytes below a
set of candidate boundaries in each partition, adds the counts up, and puts new probes into the intervals that hold a
wanted boundary, between the smallest and largest key really met there.  When every splitter is within tolerance, or
falls between two neighbouring rows, rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: A splitter may miss its place by this share of a shard.
TOLERANCE = 0.001
PROBES = 24
#: Rows of a shard are numbered in blocks of about so many bytes, each sorted by one task.
BLOCK_BYTES = 64 << 20
#: Hexadecimal digits of a key: three 64-bit numbers.
DIGITS = 48


def ordered(number: Column) -> Column:
    """A signed 64-bit number as 16 hexadecimal digits that sort like it."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")


def position(bounds: Sequence[str], key: Column) -> Column:
    """How many of the sorted bounds are smaller than the key: 0 for the first interval."""
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) < key, at + step).otherwise(at))


def _between(low: int, high: int, probes: int) -> list[int]:
    """Up to ``probes`` evenly spread keys k with low <= k < high: 'at most k' then cuts the interval."""
    width = high - low
    return sorted({low + width * i // (probes + 1) for i in range(probes + 1)} - {high}) if width > 0 else []


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """Keys that end the first ``shards - 1`` shards of ``keyed(key, bytes)`` (a key belongs to the shard it ends).

    The driver holds a bounded number of counts: at most PROBES per shard, whatever the input.
    """
    whole = keyed.agg(F.sum("bytes"), F.min("key"), F.max("key")).first()
    if whole[0] is None or shards < 2:
        return []
    total, low, high = int(whole[0]), int(whole[1], 16), int(whole[2], 16)
    wanted = [total * i // shards for i in range(1, shards)]
    slack = tolerance * total / shards
    below = {low - 1: 0, high: total}  # bytes of keys <= k, exact
    probes, unmet = _between(low, high, PROBES * shards), wanted
    while probes:
        cuts = [f"{p:0{DIGITS}X}" for p in probes]
        part = position(cuts, F.col("key")).alias("part")
        found = {r["part"]: r for r in keyed.groupBy(part).agg(F.sum("bytes").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        running = 0
        for i, probe in enumerate(probes):
            running += int(found[i]["bytes"]) if i in found else 0
            below[probe] = running
        keys = sorted(below)
        counts = [below[k] for k in keys]
        fresh: set[int] = set()
        searched, unmet = unmet, []
        for want in searched:
            i = bisect_left(counts, want)  # counts[i - 1] < want <= counts[i]
            if min(abs(counts[j] - want) for j in (i - 1, i)) <= slack:
                continue
            met = found[bisect_left(probes, keys[i])]
            inside = _between(max(int(met["low"], 16), keys[i - 1] + 1), min(int(met["high"], 16), keys[i]), PROBES)
            if inside:  # its ends are probed again, so that the next counts are those of this interval alone
                fresh.update((keys[i - 1], *inside, keys[i]))
                unmet.append(want)
        probes = sorted(fresh)
    keys = sorted(below)
    counts = [below[k] for k in keys]
    out = []
    for want in wanted:
        i = bisect_left(counts, want)
        best = min((i - 1, i), key=lambda j: abs(counts[j] - want))
        out.append(f"{max(keys[best], 0):0{DIGITS}X}")
    return sorted(out)


def shard(df: DataFrame, shards: int, text: str = "text", id: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(id, *carry, size, text_crc32, shard, slot) of every row of ``df``.

    ``size`` is the UTF-8 length of the text plus 16 bytes; a null text counts as empty, and its checksum is that of
    an empty text.  Shards hold consecutive ranges of the order (text hash, id, place), so equal texts share a shard
    unless a boundary falls among them, and a group of copies of any size is split like other rows.  ``slot`` numbers
    the rows of a shard from 0 without gaps.  Null ids come first among equal texts; repeated rows are kept; with
    fewer rows than shards some shards stay empty; an empty table gives an empty result.  ``carry`` names the columns
    to move along, all of them if texts are to be written out.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = F.col(id).cast("long")
    rows = df.select(
        number.alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("hash"), F.monotonically_increasing_id().alias("place"),
    )
    rows = written(rows)
    key = F.concat(ordered(F.col("hash")), ordered(F.coalesce("id", F.lit(-(2**63)).cast("long"))), ordered(F.col("place")))
    keyed = rows.withColumn("key", key)
    bounds = splitters(keyed.select("key", F.col("size").alias("bytes")), shards)
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = 1 + total // (shards * BLOCK_BYTES)
    placed = keyed.withColumn("shard", position(bounds, F.col("key")) if bounds else F.lit(0))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key"))
    numbered = placed.withColumn("inside", inside).join(first, ["shard", "block"])
    return numbered.select(
        F.col("id").alias(id), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"),
    )
