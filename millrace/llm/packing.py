"""Token ids of whole documents, packed into rows of fixed width by best-fit decreasing.

Documents become token ids in Arrow tasks.  A document longer than a row is split into full rows and a remainder;
nothing is cut off.  The segments of a window of documents are put, longest first, into the open row with the least
room that is enough; a segment tree over the free room finds it.  A window is a bounded number of tokens of one input
partition, so packing needs no exchange, holds a bounded number of rows, and a lost task packs the same rows again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import chunks

#: Vocabulary file on every executor, and how its library cuts text before merging (a fixed value of the vocabulary).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTH, PAD = 2048, 50256
#: Tokens packed together.
WINDOW = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Room:
    """Open rows by free room: a segment tree whose leaves are the capacities 1..width.

    Inner nodes hold how many open rows lie below, so the smallest capacity that is large enough is found by climbing
    to the first right neighbour that is not empty and descending to its leftmost leaf.
    """

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, row: int, capacity: int) -> None:
        if capacity:
            self.rows[capacity].append(row)
            self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(row, its capacity) of the smallest capacity >= length, removed; None if there is none."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        self._add(capacity, -1)
        return row, capacity


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of segment numbers.  Equal lengths keep their order; of equal rooms the latest row is taken."""
    room, rows = Room(width), []
    for segment in sorted(range(len(lengths)), key=lambda s: -lengths[s]):
        found = room.take(lengths[segment])
        if found is None:
            row, capacity = len(rows), width
            rows.append([])
        else:
            row, capacity = found
        rows[row].append(segment)
        room.put(row, capacity - lengths[segment])
    return rows


@dataclass
class Segments:
    """Segments of a window: document, first token within it, ids."""

    width: int
    docs: list = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.width):
            self.docs.append(doc)
            self.offsets.append(at)
            self.ids.append(ids[at : at + self.width])
        self.tokens += len(ids)

    def packed(self, pad: int, first: int, part: int) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(i) for i in self.ids], self.width)
        matrix = np.full((len(rows), self.width), pad, "<i4")
        bounds = []
        for row, segments in zip(matrix, rows):
            ends = np.cumsum([0, *(len(self.ids[s]) for s in segments)])
            bounds.append(ends.tolist())
            for s, a, b in zip(segments, ends[:-1], ends[1:]):
                row[a:b] = self.ids[s]
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array([b[-1] for b in bounds], pa.int32()),
                pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array(bounds, pa.list_(pa.int32())), pa.array([b[:-1] for b in bounds], pa.list_(pa.int32())),
                pa.array([[self.docs[s] for s in r] for r in rows], pa.list_(pa.int64())), pa.array([[self.offsets[s] for s in r] for r in rows], pa.list_(pa.int64())),
            ],
            ["part", "row", "used", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
        )


def pack(df: DataFrame, width: int = WIDTH, pad: int = PAD, ranks: str = RANKS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of all documents.

    ``part`` and ``row`` name a row (input partition, and number within it).  ``ids`` holds ``width`` little-endian
    32-bit ids, of which the first ``used`` are tokens and the rest ``pad``.  ``cu_seqlens`` are the cumulative segment
    lengths from 0 to ``used``; positions start again from 0 at each of ``position_resets``; ``doc_ids`` and
    ``doc_offsets`` name each segment's document and first token within it, so every document can be put together
    again.  Null and empty texts have no tokens and no segment.  Null ids stay null, repeated rows are packed each,
    other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, window = tokenizer(ranks).encode_ordinary, TaskContext.get().partitionId(), 0, Segments(width)
        for batch in chunks(batches):
            for doc, body in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if body:
                    window.add(doc, np.array(encode(body), "<i4"))
                if window.tokens >= WINDOW:
                    yield (out := window.packed(pad, row, part))
                    row, window = row + out.num_rows, Segments(width)
        if window.ids:
            yield window.packed(pad, row, part)

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, row long, used int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<bigint>")


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, offset, ids): the segments of packed rows as arrays, to be ordered by offset within a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for raw, ends, docs, offsets in zip(*(batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "doc_offsets"))):
                ids = np.frombuffer(raw, "<i4")
                for doc, offset, a, b in zip(docs, offsets, ends[:-1], ends[1:]):
                    for column, value in zip(out, (doc, offset, ids[a:b])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["doc_id", "offset", "ids"])

    return packed.select("ids", "cu_seqlens", "doc_ids", "doc_offsets").mapInArrow(run, "doc_id long, offset long, ids array<int>")


def position_ids(cu_seqlens: list[int], width: int = WIDTH) -> np.ndarray:
    """Position of each token of a row within its segment; padding continues from 0."""
    out = np.arange(width)
    for start in [*cu_seqlens[:-1], cu_seqlens[-1]]:
        out[start:] = np.arange(width - start)
    return out


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix as fixed-size binary rows beside its segment tables."""
    packed.write.parquet(path)
