"""Transaction tables as Parquet by month: append, quarantine, export, backup and restore."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.importer import ImportResult, not_stored, union_columns


def with_month(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("ym", F.date_format(time, "yyyyMM"))


def append_rows(df: DataFrame, path: str, time: str, mode: str = "append", table: str | None = None) -> None:
    """Write to month folders.  Rows are brought together by month; the runtime splits months that are large and joins
    small ones, so the number of files follows the data.  ``table`` is the folder to be read, if it holds ``path``."""
    note_columns(df, table or path)
    with_month(df, time).hint("rebalance", F.col("ym")).write.mode(mode).partitionBy("ym").parquet(path)


def note_columns(df: DataFrame, table: str) -> None:
    """Keep the columns of a table beside it, in a folder that readers of its rows pass over.

    An empty file is added only when there are columns that the table did not have, so there are as many files as the
    table has grown, and a reader needs no footers of data files.
    """
    known = noted_columns(df.sparkSession, table)
    if known is None or not set(df.columns) <= set(known.names):
        df.limit(0).coalesce(1).write.mode("append").parquet(f"{table}/_columns")


def noted_columns(spark: SparkSession, table: str) -> T.StructType | None:
    """All columns a table has ever been given."""
    try:
        return spark.read.option("mergeSchema", True).parquet(f"{table}/_columns").schema
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def read_rows(
    spark: SparkSession, path: str, time: str, start: datetime | None = None, end: datetime | None = None,
    schema: T.StructType | None = None, without_batch: int | str | None = None,
) -> DataFrame:
    """Rows of a time range; month folders outside it are not listed for reading.

    The columns are all that the table has been given (``note_columns``), NULL in files from before them; ``schema``
    names others.  ``without_batch`` leaves out what one import batch has written.
    """
    schema = noted_columns(spark, path) if schema is None else schema
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if without_batch is not None and "batch" in df.columns:
        df = df.where(F.col("batch").cast("string") != str(without_batch))
    if start is not None:
        df = df.where((F.col("ym").cast("string") >= f"{start:%Y%m}") & (F.col(time) >= F.lit(start).cast("timestamp")))
    if end is not None:
        df = df.where((F.col("ym").cast("string") <= f"{end:%Y%m}") & (F.col(time) < F.lit(end).cast("timestamp")))
    return df.drop("ym", "batch")


def write_import(result: ImportResult, path: str, time: str, batch: int | str) -> None:
    """Good rows, rejected rows, repeated rows and hourly counts, each in a folder of the batch.

    A batch that is written again replaces what it wrote before, all four outputs alike, so a run that broke off
    between them is made good by the repetition.
    """
    append_rows(result.good, f"{path}/rows/batch={batch}", time, "overwrite", f"{path}/rows")
    for name in ("errors", "duplicates", "counts"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def export_text(df: DataFrame, path: str, renames: Mapping[str, str], times: Sequence[str] = (), zone: str = "UTC", delimiter: str = ",", term: tuple[datetime, datetime] | None = None) -> None:
    """CSV or TSV with display names and local times; ``term`` adds the columns ``term_from`` and ``term_to``."""
    out = display_rows(df, renames, times, zone, term)
    out.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def display_rows(df: DataFrame, renames: Mapping[str, str], times: Sequence[str] = (), zone: str = "UTC", term: tuple[datetime, datetime] | None = None) -> DataFrame:
    """Columns under display names, times as local text, and the term the rows were asked for."""

    def local(at):
        return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm:ss.SSS")

    shown = df.withColumns({t: local(F.col(t)) for t in times}).select(*[F.col(a).alias(b) for a, b in renames.items()])
    if term:
        shown = shown.withColumns({n: local(F.lit(at).cast("timestamp")) for n, at in zip(("term_from", "term_to"), term)})
    return shown


def export_zip(df: DataFrame, path: str, delimiter: str = ",", rows: int = 500_000) -> int:
    """One zip file per ``rows`` rows and task, each with one text file; returns the number of rows written.

    A task holds the text of one file.  Files are named by task, so a task that runs again replaces its own.
    """
    kind = "tsv" if delimiter == "\t" else "csv"
    target = re.sub(r"^file:/(?!/)", "file:///", path)
    target = target if "://" in target else f"file://{target}"

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = fs.FileSystem.from_uri(target)
        system.create_dir(inner, recursive=True)
        parts: list[pd.DataFrame] = []

        def save(number: int) -> int:
            name = f"part-{TaskContext.get().partitionId():05d}-{number:03d}"
            text, data = pd.concat(parts).to_csv(index=False, sep=delimiter), io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"{name}.{kind}", text)
            with system.open_output_stream(f"{inner}/{name}.zip") as out:
                out.write(data.getvalue())
            return sum(len(p) for p in parts)

        number = 0
        for batch in batches:
            parts.append(batch)
            if sum(len(p) for p in parts) >= rows:
                yield pd.DataFrame({"n": [save(number)]})
                parts, number = [], number + 1
        if any(len(p) for p in parts):
            yield pd.DataFrame({"n": [save(number)]})

    return df.mapInPandas(archive, "n long").agg(F.sum("n")).first()[0] or 0


def backup_days(df: DataFrame, path: str, time: str) -> None:
    """One folder per day."""
    dated = df.withColumn("day", F.date_format(time, "yyyy-MM-dd"))
    dated.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(path)


def restore_days(stored: DataFrame, path: str, time: str, days: Sequence[str]) -> DataFrame:
    """Backed-up rows of some days that the table does not hold already, on the table's columns."""
    spark = stored.sparkSession
    saved = spark.read.parquet(path).where(F.col("day").cast("string").isin(list(days))).drop("day")
    aligned = union_columns(stored.limit(0), saved)
    return not_stored(aligned, stored, time, stored.columns)
