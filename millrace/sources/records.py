"""Records of delimited text whose quoted values hold line ends, without giving up splits.

A line alone does not tell whether it begins inside a quoted value.  Each split is read once for what it does to both
possible states at its start; these small functions are composed in file order, so every split learns the state it
begins in.  In the second pass each task joins its lines to records; the lines at a split's start that belong to a
record of an earlier split, and the open record at its end, travel as pieces and are put together by record.

Lines are handled a batch at a time.  Where every quote of a line opens a value, closes one or is one of a doubled pair,
the state after the line follows from the number of its quotes; the other lines are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import settle, written

BLOCK = "file long, block long"
#: Text that one task reads at least, from several splits where these are smaller, as long as every core has four tasks.
TASK_BYTES = 64 << 20


def inside_after(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted value is open after the line; quotes count where a value begins with one."""
    at, end = 0, len(line)
    while True:
        if not inside:
            while line[at : at + 1] != '"':
                at = line.find(delimiter, at)
                if at < 0:
                    return False
                at += len(delimiter)
            at += 1
        while True:  # to the quote that closes the value: not one of a doubled pair
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] != '"':
                break
            at += 2
        at = line.find(delimiter, at + 1)
        inside = False
        if at < 0 or at >= end:
            return False
        at += len(delimiter)


class Quotes:
    """The lines of one batch and what their quotes do to the state."""

    def __init__(self, lines: pa.Array, delimiter: str):
        self.lines, self.delimiter = lines, delimiter
        wide = pa.types.is_large_string(lines.type)
        ends = np.frombuffer(lines.buffers()[1], np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
        data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[: ends[-1]]
        self.ends, self.data = ends, data
        at = ends[0] + np.flatnonzero(data[ends[0] :] == 34)
        before = np.searchsorted(at, ends)  # quotes before each line
        #: lines with quotes, and after each line whether so many quotes are odd
        self.some = np.diff(before) > 0
        self.odd = (np.diff(before) & 1).astype(bool)
        line = np.repeat(np.arange(len(lines)), np.diff(before))
        first = at == ends[line]
        previous = data[np.maximum(at - 1, 0)] if len(at) else data[:0]
        # a quote that may open: at the start of a value or after the quote that it doubles
        opens = first | (previous == 34)
        if len(delimiter.encode()) == 1:
            opens |= previous == ord(delimiter)
        number = np.arange(len(at)) - before[line]  # of the quote in its line
        odd_one = (number & 1).astype(bool)
        #: lines to be looked at one by one if they begin outside, and inside, a quoted value
        self.single = [np.zeros(len(lines), bool), np.zeros(len(lines), bool)]
        self.single[0][line[~opens & ~odd_one]] = True
        self.single[1][line[~opens & odd_one]] = True

    def after(self, i: int, inside: bool) -> bool:
        if not self.some[i]:
            return inside
        if self.single[int(inside)][i]:
            return inside_after(self.lines[i].as_py(), self.delimiter, inside)
        return inside ^ bool(self.odd[i])

    def blank(self, asked: np.ndarray) -> np.ndarray:
        """Whether lines hold nothing but white space; False for lines not asked for."""
        out = asked & (self.ends[1:] == self.ends[:-1])
        begin = self.data[np.minimum(self.ends[:-1], len(self.data) - 1)] if len(self.data) else np.zeros(len(out), np.uint8)
        for i in np.flatnonzero(asked & ~out & ((begin <= 32) | (begin > 127))).tolist():
            out[i] = not self.lines[i].as_py().strip()
        return out

    def states(self, inside: bool) -> np.ndarray:
        """State before each line, and after the last."""
        odd = np.logical_xor.accumulate(np.concatenate([[inside], self.odd]))
        # the lines at which the state may be another one than the number of quotes tells, for either state
        here = np.where(odd[:-1], self.single[1], self.single[0])
        there = np.where(odd[:-1], self.single[0], self.single[1])
        places, turned, turns, at = [np.flatnonzero(here), np.flatnonzero(there)], False, [], 0
        while True:
            k = np.searchsorted(places[turned], at)
            if k == len(places[turned]):
                break
            i = int(places[turned][k])
            if inside_after(self.lines[i].as_py(), self.delimiter, bool(odd[i]) ^ turned) != bool(odd[i + 1]) ^ turned:
                turned = not turned
                turns.append(i + 1)
            at = i + 1
        if turns:
            flip = np.zeros(len(odd), bool)
            flip[turns] = True
            odd = odd ^ np.logical_xor.accumulate(flip)
        return odd


def _lines(spark: SparkSession, paths: str | Sequence[str], encoding: str) -> DataFrame:
    """(file, block, value): all lines."""
    lines = spark.read.option("encoding", encoding).text(paths)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return _packed(lines)


def _packed(df: DataFrame) -> DataFrame:
    """Rows read from files; small splits are read several by a task, one after the other."""
    spark = df.sparkSession
    splits = df.rdd.getNumPartitions()
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-splits * size // TASK_BYTES))
    return df.coalesce(tasks) if tasks < splits else df


def _by_block(batches: Iterator[pa.RecordBatch], skip: int) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """((file, block), lines) of the runs of rows of one block, without the first ``skip`` lines of each file."""
    now, seen = None, 0
    for batch in batches:
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if start == stop:
                continue
            at = (int(file[start]), int(block[start]))
            if at != now:
                now, seen = at, 0
            if at[1] == 0 and seen < skip:
                left = min(skip - seen, stop - start)
                start, seen = start + left, seen + left
            if start < stop:
                yield at, batch.slice(start, stop - start)


def _effects(lines: DataFrame, delimiter: str, skip: int) -> DataFrame:
    """(file, block, out, into, through): what a block does to the state at its start.

    ``out`` and ``into`` are the state after it if it begins outside, or inside, a quoted value; ``through`` tells whether
    every line of it belongs to the record that is then open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        out, into, through = False, True, True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), *(pa.array([x]) for x in (out, into, through))], ["file", "block", "out", "into", "through"])

        for at, batch in _by_block(batches, skip):
            if now is not None and now != at:
                yield row()
            if now != at:
                now, out, into, through = at, False, True, True
            quotes = Quotes(batch.column("value"), delimiter)
            states, since = quotes.states(out), 0
            if into != out:  # line by line until both states have become the same
                since = None
                for i in np.flatnonzero(quotes.some).tolist():
                    into = quotes.after(i, into)
                    through = through and into
                    if into == states[i + 1]:
                        since = i + 1
                        break
            out = bool(states[-1])
            if since is not None:
                into, through = out, through and bool(states[since + 1 :].all())
        if now is not None:
            yield row()

    return lines.mapInArrow(run, f"{BLOCK}, out boolean, into boolean, through boolean")


def _starts(effects: DataFrame) -> DataFrame:
    """(file, block, owner) of the blocks that begin inside a quoted value: the block whose record is then open.

    The effects of a file's blocks, one row for each of its splits, are composed in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, owner = None, False, 0
        for batch in batches:
            rows = []
            for file, block, out, into, through in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "out", "into", "through"))):
                if file != now:
                    now, inside = file, False
                if inside:
                    rows.append((file, block, owner))
                if not (inside and through):
                    owner = block
                inside = into if inside else out
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["file", "block", "owner"])

    return effects.repartition("file").sortWithinPartitions("file", "block").mapInArrow(run, f"{BLOCK}, owner long")


def has_open_lines(spark: SparkSession, paths: str | Sequence[str], delimiter: str, encoding: str) -> bool:
    """Whether any line ends inside a quoted value, seen from a start outside of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes = Quotes(batch.column("value"), delimiter)
            if (quotes.odd & ~quotes.single[0]).any() or any(quotes.after(i, False) for i in np.flatnonzero(quotes.single[0]).tolist()):
                yield pa.RecordBatch.from_arrays([pa.array([True])], ["found"])
                return

    lines = spark.read.option("encoding", encoding).text(paths).where(F.col("value").contains('"'))
    return bool(lines.mapInArrow(run, "found boolean").take(1))


def read_records(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """(file, block, value): every record of the files, line ends inside quoted values as ``\\n``.

    ``file`` is a hash of the path.  The first ``skip`` lines of each file are left out, by position; they are taken as
    they are, without quoted values over several lines.  Blank lines between records are left out, too.
    """
    lines = _lines(spark, paths, encoding)
    # three numbers per split that begins inside a quoted value, 24 bytes for each 128 MB of text at most
    starts = settle(_starts(_effects(lines, delimiter, skip)).select(F.xxhash64("file", "block").alias("_key"), "owner"))
    lines = lines.withColumn("_key", F.xxhash64("file", "block")).join(F.broadcast(starts), "_key", "left").drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, owner, inside, held = None, False, 0, False, []

        def rows(done: pa.Array, pieces: list[tuple[int, str]], at: tuple[int, int]) -> pa.RecordBatch:
            n, m = len(done), len(pieces)
            value = pa.concat_arrays([done, pa.array([p for _, p in pieces], pa.string())])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + m, at[0], np.int64)), pa.array(np.full(n + m, at[1], np.int64)), value, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([o for o, _ in pieces], pa.int64())])],
                ["file", "block", "value", "owner"],
            )

        for at, batch in _by_block(batches, skip):
            pieces: list[tuple[int, str]] = []
            alone: list[str] = []
            if now != at:
                if held:
                    yield rows(pa.array([], pa.string()), [(owner if first else now[1], "\n".join(held))], now)
                now, owner, held = at, batch.column("owner")[0].as_py(), []
                first = inside = owner is not None  # the lines at hand belong to a record of an earlier block
            quotes = Quotes(batch.column("value"), delimiter)
            states = quotes.states(inside)
            keep = states[:-1] | ~quotes.blank(~states[:-1])
            kept, begins = quotes.lines.filter(pa.array(keep)), np.flatnonzero(~states[:-1][keep])
            inside = bool(states[-1])
            before = int(begins[0]) if len(begins) else len(kept)
            if before:  # lines of the record that was open
                held.extend(kept.slice(0, before).to_pylist())
                if len(begins) or not inside:
                    if first:
                        pieces.append((owner, "\n".join(held)))
                    else:
                        alone.append("\n".join(held))
                    held, first = [], False
            ends = np.append(begins, len(kept))
            if inside and len(begins):
                held, ends = kept.slice(int(begins[-1])).to_pylist(), begins
            if len(ends) == ends[-1] - before + 1:
                done = kept.slice(before, len(ends) - 1)
            else:
                done = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), kept), "\n")
            done = pa.concat_arrays([pa.array(alone, pa.string()), done.cast(pa.string())])
            if len(done) or pieces:
                yield rows(done, pieces, now)
        if held:
            yield rows(pa.array([], pa.string()), [(owner if first else now[1], "\n".join(held))], now)

    found = lines.mapInArrow(run, f"{BLOCK}, value string, owner long")
    if not starts.take(1):
        return found.select("file", "block", "value")
    found = _packed(written(found))
    pieces = found.where("owner is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("all"))
    joined = pieces.select("file", F.col("owner").alias("block"), F.array_join(F.col("all.value"), "\n").alias("value"))
    return found.where("owner is null").select("file", "block", "value").union(joined)
