"""Delimited text files: detection of delimiter, encoding and header, reading, transposed files, new files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.reshape import number_names
from millrace.sources import records

HEAD_BYTES = 65_536
DELIMITERS = [",", "\t", ";"]


def guess_delimiter(lines: Sequence[str]) -> str:
    """The candidate whose smallest count over the last lines is largest."""
    tail = list(lines[max(0, len(lines) - 11) : max(1, len(lines) - 1)]) or [""]
    return max(DELIMITERS, key=lambda d: min(line.count(d) for line in tail))


def guess_encoding(head: bytes) -> str:
    """UTF-8 when the bytes allow it, Shift-JIS otherwise; a character cut at the end does not count."""
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "shift_jis"


def guess_header(lines: Sequence[str], delimiter: str) -> int:
    """Lines before the header: the header starts the run of lines with the usual number of fields."""
    widths = [line.count(delimiter) for line in lines]
    usual = Counter(w for w in widths if w).most_common(1)
    if not usual:
        return 0
    for i, width in enumerate(widths):
        if width == usual[0][0]:
            return i
    return 0


_QUOTED = re.compile(r'(?<![^,;\t\n])"(?:[^"]|"")*"')


def guess_shape(text: str, skip: int | None = None) -> tuple[str, int, list[str], list[str]]:
    """(delimiter, lines before the header, header, lines up to the header) of the first lines of a file.

    Quoted values are taken out for counting, so delimiters and line ends inside them do not matter.
    """
    text = re.sub("\r\n?", "\n", text)
    bare = _QUOTED.sub(lambda m: "\0" * m[0].count("\n"), text).split("\n")[:100]
    delimiter = guess_delimiter(bare)
    before = skip
    if before is None:
        before = guess_header(bare, delimiter)
        before += sum(line.count("\0") for line in bare[:before])
    lines = text.split("\n")
    return delimiter, before, next(csv.reader(lines[before : before + 1], delimiter=delimiter), []), lines[: before + 1]


def split_unit(name: str) -> tuple[str, str]:
    """``name [unit]`` as (name, unit)."""
    parts = re.split(r" \[|\] |\[|\]", name)
    return parts[0], parts[1] if len(parts) > 1 else ""


# Fixed value: first column of a measurement export with seven header lines.
KNOWN_LAYOUT = ["検索期間", "ライン", "工程", "設備", "特性名", "", ""]


def known_layout(lines: Sequence[str], delimiter: str) -> dict[str, list[str]] | None:
    """Line, process and machine per column, item names and units of the known seven-line header; None for others."""
    rows = [[v.strip() for v in r] for r in csv.reader(lines[:7], delimiter=delimiter)]
    if len(rows) < 7 or [r[0] if r else "" for r in rows] != KNOWN_LAYOUT:
        return None
    width = max(map(len, rows))
    rows = [[v.replace("#N/A", "-") for v in r] + [""] * (width - len(r)) for r in rows]
    machines, last = [], ""
    for cell in ["", *rows[3][1:]]:
        last = cell or last
        machines.append(last)
    return {"line": [rows[1][1]] * width, "process": [rows[2][1]] * width, "machine": machines, "item": ["", *rows[4][1:]],
            "unit": rows[5], "detail": rows[6]}


def _open(path: str):
    """Seekable handle on any file system Arrow knows; only what is read is fetched."""
    uri = re.sub(r"^file:/(?!/)", "file:///", path)
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def _heads(path: str) -> Iterator[tuple[str, bytes, bytes | None]]:
    """(member, first bytes, all bytes of a zip member) of a plain file or of every member of a zip file."""
    with _open(path) as f:
        if f.read(2) != b"PK":
            f.seek(0)
            yield "", f.read(HEAD_BYTES), None
            return
        f.seek(0)
        with zipfile.ZipFile(f) as z:
            for name in z.namelist():
                if not name.endswith("/"):
                    data = z.read(name)
                    yield name, data[:HEAD_BYTES], data


def valid_utf8(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, utf8): whether all lines of a file are UTF-8.  Files are split and read whole."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))


def describe_files(spark: SparkSession, path: str, glob: str = "*", skip: int | None = None) -> DataFrame:
    """(path, member, encoding, delimiter, skip, header, preamble): one row per file, or per member of a zip file.

    The encoding follows from the complete file, delimiter and header from its first lines.  ``preamble`` holds the
    lines up to and including the header, which follows ``skip`` lines where that is given.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, utf8 in zip(batch["path"], batch["utf8"]):
                for member, head, data in _heads(name):
                    encoding = guess_encoding(data) if data is not None else "utf-8" if utf8 in (True, None) else "shift_jis"
                    delimiter, before, names, preamble = guess_shape(head.decode(encoding, errors="ignore"), skip)
                    rows.append((name, member, encoding, delimiter, before, [n.strip() for n in names], preamble))
            yield pd.DataFrame(rows, columns=["path", "member", "encoding", "delimiter", "skip", "header", "preamble"])

    schema = "path string, member string, encoding string, delimiter string, skip int, header array<string>, preamble array<string>"
    listed = list_files(spark, path, glob).select("path")
    checked = valid_utf8(spark, path, glob)
    return listed.join(checked, "path", "left").mapInPandas(look, schema)


def read_delimited(spark: SparkSession, path: str | Sequence[str], header: Sequence[str] | None = None, delimiter: str = ",", encoding: str = "UTF-8", preamble: Sequence[str] = ()) -> DataFrame:
    """All columns as text.

    Files that start with their header use Spark's reader.  For files with lines before it, as many lines as
    ``preamble`` has (see ``describe_files``) are left out at the start of each.  Where quoted values hold line ends,
    records are put together first (``records.read_records``).  Files are split in every case.
    """
    if len(preamble) > 1 or records.has_open_lines(spark, path, delimiter, encoding):
        if header is None and len(preamble) <= 1:
            header = [re.sub(r"^_c(\d+)$", r"column_\1", c) for c in spark.read.csv(path, sep=delimiter, header=True, encoding=encoding, enforceSchema=False).columns]
            preamble = ("",)
        names = number_names([n.strip() for n in header or next(csv.reader([preamble[-1]], delimiter=delimiter))])
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        rows = records.read_records(spark, path, delimiter, encoding, len(preamble))
        return rows.select(F.from_csv("value", _ddl(schema), {"sep": delimiter, "escape": '"', "maxCharsPerColumn": "-1"}).alias("r")).select("r.*")
    if header is not None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in number_names(list(header))])
        return spark.read.csv(path, sep=delimiter, schema=schema, header=False, encoding=encoding)
    df = spark.read.csv(path, sep=delimiter, header=True, encoding=encoding, inferSchema=False, enforceSchema=False)
    return df.toDF(*number_names([re.sub(r"^_c(\d+)$", r"column_\1", c.strip()) for c in df.columns]))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema)


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of every member of a zip file, or of the file itself."""
    if content[:2] != b"PK":
        yield "", content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if not name.endswith("/"):
                yield name, z.read(name)


def read_whole(spark: SparkSession, path: str | Sequence[str], transpose: bool = False, skip: int | None = 0, glob: str = "*") -> DataFrame:
    """(path, row, field, value) of transposed files and of all members of zip files (``path#member``).

    Such a file cannot be split, so each is read by one task; many files still spread over tasks.  With ``skip`` None
    the lines before the header are found for each member.
    """
    binary = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for member, header, rows in _member_rows(content, skip, transpose):
                    where = f"{name}#{member}" if member else name
                    cells = [(where, i, h, v) for i, r in enumerate(rows) for h, v in zip(header, r)]
                    yield pd.DataFrame(cells, columns=["path", "row", "field", "value"])

    return binary.select("path", "content").mapInPandas(parse, "path string, row long, field string, value string")


def _member_rows(content: bytes, skip: int | None, transpose: bool = False) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(member, header, rows) of a file or of each member of a zip file."""
    for member, data in _members(content):
        text = data.decode(guess_encoding(data), errors="replace")
        delimiter, before, _, _ = guess_shape(text[:HEAD_BYTES], skip)
        rows = list(csv.reader(io.StringIO("\n".join(re.split("\r\n?|\n", text)[before:])), delimiter=delimiter))
        if transpose:
            rows = [list(r) for r in zip(*rows)]
        yield member, number_names([h.strip() for h in rows[0]]) if rows else [], rows[1:]


def read_members(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str], skip: int | None = 0, glob: str = "*") -> DataFrame:
    """The named fields of all rows of ``read_whole``, put side by side where the rows are read, without a shuffle."""
    binary = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    fields = list(fields)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for _, header, rows in _member_rows(content.as_py(), skip):
                    at = {h: i for i, h in enumerate(header)}
                    rows = [r for r in rows if r] if header else []
                    for start in range(0, len(rows), 10_000):
                        some = rows[start : start + 10_000]
                        columns = [[r[at[f]] if f in at and at[f] < len(r) else None for r in some] for f in fields]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], fields)

    return binary.select("content").mapInArrow(parse, _ddl(T.StructType([T.StructField(f, T.StringType()) for f in fields])))


def cells_to_frame(cells: DataFrame, fields: Sequence[str]) -> DataFrame:
    picked = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return cells.groupBy("path", "row").agg(*picked)


def dummy_header(count: int) -> list[str]:
    return [f"column_{i + 1}" for i in range(count)]


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not yet imported, by path and change time."""
    seen = manifest.select(F.col("path").alias("_p"), F.col("modified").alias("_m"))
    return listing.join(seen, (F.col("path") == F.col("_p")) & (F.col("modified") <= F.col("_m")), "left_anti")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


# Other spellings of standard columns in measurement and history files.
STANDARD_NAMES = {
    "Line": "ライン名", "Process": "工程名", "Equip": "子設備名", "EquipId": "子設備ID", "PartNo": "品番",
    "DateTime": "計測日時", "DataId": "計測項目ID", "DataName": "計測項目名", "Value": "計測値", "Serial": "シリアルNo",
}


def standard_names(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their standard names."""
    return df.withColumnsRenamed({a: s for a, s in aliases.items() if a in df.columns})


def na_candidates(df: DataFrame, cols: Sequence[str], longest: int = 7) -> DataFrame:
    """(value, n): short texts that look like a missing mark rather than a number, date or word."""
    cells = F.array(*[F.trim(F.col(c).cast("string")) for c in cols])
    counts = df.select(F.explode(cells).alias("value")).where(F.length("value").between(1, longest))
    counts = counts.groupBy("value").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("value", r"([ ,;:]|\[.*\]|\(.*\)|[^\x01-\x7E])", "")
    bare = F.regexp_replace(bare, r"( |\d{1,2}/\d|-?\d*\.?\d+$)", "")
    bare = F.regexp_replace(bare, r"(^[a-z]+$|^[A-Z]{3,}$)", "")
    return counts.where((bare == F.col("value")) & ~F.col("value").isin("Inf", "-Inf", "inf", "-inf", "#DIV/0!", "#VALUE!"))


def escape_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n): repeated values made of nines, as 9999 or 99.99."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")
    counts = long.where(F.col("value").rlike(r"^(9+\.?9*)$")).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > 1)
