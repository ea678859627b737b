"""From a folder of text files to an import, and from records to master names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import names
from millrace.operators.reshape import number_names
from millrace.plans.importer import ImportResult, ImportSpec, import_batch
from millrace.session import dealt, prepare, written
from millrace.sources import files, profile

#: Cells whose values one task counts; a task's memory does not grow with the folder.
CELLS = 3_000_000


def read_folder(spark: SparkSession, path: str, glob: str = "*.csv", skip: int | None = None) -> DataFrame:
    """All rows of a folder as text, each file by its own encoding, delimiter, lines before the header and columns.

    Files of one shape are read together; shapes are united by column name.  Zip files give all their members.
    """
    shapes = files.describe_files(prepare(spark), path, glob, skip)
    found: dict[tuple, list[str]] = {}
    for r in shapes.select("path", "member", "encoding", "delimiter", "preamble", "header").collect():  # one row per file
        key = ("zip", *r["header"]) if r["member"] else (r["encoding"], r["delimiter"], *r["preamble"])
        found.setdefault(key, []).append(r["path"])
    zipped = {p for key, paths in found.items() if key[0] == "zip" for p in paths}
    parts = [
        files.read_delimited(spark, paths, delimiter=key[1], encoding=key[0], preamble=key[2:])
        for key, paths in found.items()
        if key[0] != "zip"
    ]
    if zipped:
        fields = list(dict.fromkeys(n for key in found if key[0] == "zip" for n in number_names(key[1:])))
        parts.append(files.read_members(spark, sorted(zipped), fields, skip))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest_files(
    spark: SparkSession, path: str, time: str, glob: str = "*.csv", zone: str = "UTC", stored: DataFrame | None = None,
    skip: int | None = None, n_rows: int | None = None,
) -> ImportResult:
    """Register a folder in one step: each file's shape, types from all rows, then the import.

    ``skip`` states the lines before the header where they are not to be found out, ``n_rows`` asks for a trial with
    so many rows.
    """
    raw = read_folder(spark, path, glob, skip)
    raw = written(raw if n_rows is None else raw.limit(n_rows))
    data = [c for c in raw.columns if c != time]
    kinds = profile.infer_types(dealt(raw, CELLS // max(1, len(data))), data)
    plain = {c: "TEXT" if k in ("CATEGORY", "DATE", "TIME") else k for c, k in kinds.items()}
    return import_batch(raw, ImportSpec(time, plain, zone=zone), stored)


def scan_columns(df: DataFrame, name: str, units: Sequence[str] = ()) -> DataFrame:
    """(raw, name, unit) of the distinct data names of a source."""
    raw = df.select(F.col(name).alias("raw")).where(F.col(name).isNotNull()).distinct()
    parts = names.data_name(F.col("raw"), units)
    return raw.select("raw", parts["name"].alias("name"), parts["unit"].alias("unit"))
