"""Words of whole texts as integer codes, a batch at a time, inside Arrow tasks.

A word is a longest run of bytes other than space and ``\\x09``-``\\x0D``.  Texts keep every word; long texts only make a
batch smaller, never shorter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once in a task; a single longer text is handled alone.
CHUNK_BYTES = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one piece hold at most ``limit`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def whole(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, bytes, np.ndarray]:
    """(texts, their bytes in one piece, size of each) as an array of its own, null texts empty.

    Slices are copied, and letters A-Z lowered as bytes, because Arrow's own lowering misreads sliced arrays.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = texts.buffers()[2]
    first = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]) if len(texts) else 0
    raw = data.slice(first, int(offsets[-1])).to_pybytes() if data is not None else b""
    raw = raw.lower() if lower else raw
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw)), raw, sizes


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, dictionary of words, first word of each text plus the total).  Null texts have no words."""
    lists = pc.ascii_split_whitespace(whole(texts, lower)[0])
    flat, bounds = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = bounds - bounds[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # blanks at either end of a text give empty words
        before = np.concatenate([[0], np.cumsum(real)])
        flat, bounds = flat.filter(pa.array(real)), before[bounds]
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, coded.dictionary, bounds.astype(np.int64)


def word_hashes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every process."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))


def word_count(text: str) -> Column:
    """Number of words of a text column; null for null."""
    return F.regexp_count(F.col(text), F.lit(WORD)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of each text (ASCII lower case).

    A text of fewer words has its whole word sequence as its only shingle; a text without words has none.
    """
    codes, dictionary, bounds = split_words(texts, lower=True)
    own = word_hashes(dictionary)[codes] if len(codes) else np.empty(0, np.uint64)
    factor = odd_numbers(width + 1, 77)
    total = max(0, len(own) - width + 1)
    runs = np.zeros(total, np.uint64)
    for j in range(width):
        runs += own[j : j + total] * factor[j]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            length = np.array([b - a], np.uint64) * factor[width]
            out.append(mix(length + (own[a:b] * factor[: b - a]).sum(dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def as_input(df: DataFrame, column: str, kind: str) -> Column | str:
    """An input for ``append_columns``: the column cast to a type, or its name alone if it is of that type already."""
    plain = "." not in column and df.columns.count(column) == 1 and df.schema[column].dataType == T.DataType.fromDDL(kind)
    return column if plain else F.col(column).cast(kind)


def append_columns(df: DataFrame, inputs: dict[str, Column | str], new: dict[str, str], make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], by: str | None = None, limit: int = CHUNK_BYTES, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with columns computed by Arrow tasks; rows pass through whole, in place, without a shuffle.

    ``inputs`` names the expressions that the task sees, ``new`` the types of the columns it returns, ``make()`` is
    called once in each task and gives the function for a batch.  Batches hold a bounded number of bytes of the
    string input ``by``.  Columns of ``df`` named like a new one are replaced; any other names are safe.  An input given
    as the name of a column that is kept is sent once, not beside it.  ``keep`` names the columns to keep, if not all.
    """
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    carried, names, many = [f"c{i}" for i in range(len(kept))], list(inputs), len(new)
    shared = {f.name: c for f, c in zip(kept, carried)}
    seen = [shared.get(e, f"i_{name}") if isinstance(e, str) else f"i_{name}" for name, e in inputs.items()]
    sent = {c: F.col(f"`{e}`") if isinstance(e, str) else e for c, e in zip(seen, inputs.values()) if c not in carried}
    text = seen[names.index(by)] if by else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in chunks(batches, text, limit) if text else batches:
            if part.num_rows:
                given = pa.RecordBatch.from_arrays([part.column(c) for c in seen], names)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carried], *work(given)], [*carried, *[f"n{i}" for i in range(many)]])

    plain = df.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(kept, carried)], *[e.alias(c) for c, e in sent.items()])
    schema = T.StructType([T.StructField(c, f.dataType) for f, c in zip(kept, carried)])
    for i, kind in enumerate(new.values()):
        schema = schema.add(f"n{i}", T.DataType.fromDDL(kind))
    out = plain.mapInArrow(run, schema)
    return out.select(*[F.col(c).alias(f.name) for f, c in zip(kept, carried)], *[F.col(f"n{i}").alias(name) for i, name in enumerate(new)])
