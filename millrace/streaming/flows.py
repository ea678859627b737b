"""Streams over arriving files: import, de-duplication, counters, windows, links and alarms.

Late data: rows behind the watermark are dropped from stateful results; a batch pull over their time range brings
them in, as import de-duplicates against stored rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.numeric import epoch_us
from millrace.operators.aggregate import OPERATORS
from millrace.operators.links import MINUTE, time_link
from millrace.operators.ordering import first_rows
from millrace.plans.importer import ImportSpec, import_batch
from millrace.sources.store import read_rows, write_import


def new_file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None, **options: str) -> DataFrame:
    """Files that appear in a folder, each once; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def import_micro_batch(batch: DataFrame, batch_id: int, spec: ImportSpec, path: str) -> None:
    """Import one batch against the rows of all other batches and write its outputs under its id.

    Run again after a failure, it sees the same stored rows and replaces its own outputs: rows, errors, duplicates
    and counts are there exactly once.
    """
    spark = batch.sparkSession

    def stored(lo: datetime, hi: datetime) -> DataFrame | None:
        try:
            return read_rows(spark, f"{path}/rows", spec.time, lo, hi + timedelta(microseconds=1), without_batch=batch_id)
        except AnalysisException as error:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            return None

    write_import(import_batch(batch, spec, stored), path, spec.time, batch_id)


def import_stream(stream: DataFrame, spec: ImportSpec, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes through ``import_micro_batch``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        import_micro_batch(batch, batch_id, spec, path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_repeats(stream: DataFrame, time: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """Re-delivered rows dropped; state is kept for ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def hourly_counter(stream: DataFrame, time: str, keys: Sequence[str] = (), delay: str = "1 hour", change: str | None = None) -> DataFrame:
    """Records per hour and key.  With ``change`` (1 for an added record, -1 for a deleted one) counters also go down."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), *keys)
    return windowed.agg((F.sum(change) if change else F.count("*")).alias("n")).select(F.col("window.start").alias("hour"), *keys, "n")


def cyclic_windows(stream: DataFrame, time: str, value: str, length: str, every: str, delay: str = "1 hour") -> DataFrame:
    """Mean and count per window of ``length`` starting ``every`` so often."""
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, length, every))
    out = windowed.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("term_from"), F.col("window.end").alias("term_to"), "n", "mean")


def _before(spark: SparkSession, path: str, batch_id: int | None) -> tuple[int | None, int | None]:
    """(last batch, its watermark) of what the linking of streams has written before a batch, or in all."""
    schema = "batch int, watermark long"
    try:
        marks = spark.read.schema(schema).parquet(f"{path}/marks")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, None
    marks = marks if batch_id is None else marks.where(F.col("batch") < batch_id)
    last = marks.agg(F.max(F.struct("batch", "watermark")).alias("m")).first()["m"]
    return (None, None) if last is None else (last["batch"], last["watermark"])


def _closed(left_time: str, span: int, watermark: int | None) -> Column:
    """Start records whose last possible target time the watermark has reached; records without a time are closed at once."""
    known = F.lit(False) if watermark is None else epoch_us(F.col(left_time)) + span <= F.lit(watermark)
    return F.col(left_time).isNull() | known


def _linked(waiting: DataFrame, path: str, schema: T.StructType, right_time: str, last: int, how: Mapping) -> DataFrame:
    """Start records linked with the stored targets of the time range they can reach."""
    spark = waiting.sparkSession
    low, high = waiting.agg(F.min(how["left_time"]), F.max(how["left_time"])).first()
    targets = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/targets").where(F.col("batch") <= last).drop("batch")
    if low is not None:
        reach = timedelta(minutes=abs(how["delta_minutes"]) + abs(how.get("cut_off_minutes", 0.0)) + 1)
        targets = targets.where(F.col(right_time).between(F.lit(low - reach), F.lit(high + reach)))
    return time_link(waiting, targets, right_time=right_time, **how)


def link_micro_batch(batch: DataFrame, batch_id: int, path: str, right_time: str, delay: timedelta, **how) -> None:
    """One batch of start and target records (columns ``start`` and ``target``, one of them null).

    Targets are stored, and starts wait.  The watermark is the latest target time so far less ``delay``.  A start is
    linked, once, when the watermark has reached the end of its interval, so all targets it can have are stored.
    ``waiting``, ``targets``, ``links`` and ``marks`` are folders by batch; a repeated batch sees what the one before
    it left and replaces its own.
    """
    spark = batch.sparkSession
    left_time, cut = how["left_time"], abs(how.get("cut_off_minutes", 0.0))
    span = round((max(how["delta_minutes"], 0) + cut) * MINUTE)
    schemas = [T.StructType(list(batch.schema[c].dataType.fields)) for c in ("start", "target")]
    last, watermark = _before(spark, path, batch_id)

    batch.where("target is not null").select("target.*").write.mode("overwrite").parquet(f"{path}/targets/batch={batch_id}")
    starts = batch.where("start is not null").select("start.*")
    if last is not None:
        held = spark.read.schema(schemas[0]).parquet(f"{path}/waiting/batch={last}")
        starts = held.where(~_closed(left_time, span, watermark)).unionByName(starts)
    starts.write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")

    new = spark.read.schema(schemas[1]).parquet(f"{path}/targets/batch={batch_id}").agg(F.max(epoch_us(F.col(right_time)))).first()[0]
    new = None if new is None else new - round(delay / timedelta(microseconds=1))
    watermark = max((x for x in (watermark, new) if x is not None), default=None)
    ready = spark.read.schema(schemas[0]).parquet(f"{path}/waiting/batch={batch_id}").where(_closed(left_time, span, watermark))
    _linked(ready, path, schemas[1], right_time, batch_id, how).write.mode("overwrite").parquet(f"{path}/links/batch={batch_id}")
    spark.range(1).select(F.lit(watermark).cast("long").alias("watermark")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")


def link_streams(starts: DataFrame, targets: DataFrame, path: str, checkpoint: str, right_time: str, delay: timedelta = timedelta(hours=1), **how) -> StreamingQuery:
    """Two streams linked as ``links.time_link`` links two tables, whichever of both records arrives first.

    Targets may be out of order by ``delay``; a target later than that still links starts that wait.  Starts wait until
    no further target can reach them (``close_links`` ends the waiting), so links are final, there is one linking of
    each start, and no pairs beyond the result are made or kept.
    """
    sides = [F.struct(*[F.col(c) for c in side.columns]) for side in (starts, targets)]
    kinds = [T.StructType([T.StructField(f.name, f.dataType) for f in side.schema]) for side in (starts, targets)]
    both = starts.select(sides[0].cast(kinds[0]).alias("start"), F.lit(None).cast(kinds[1]).alias("target"))
    both = both.union(targets.select(F.lit(None).cast(kinds[0]).alias("start"), sides[1].cast(kinds[1]).alias("target")))

    def save(batch: DataFrame, batch_id: int) -> None:
        link_micro_batch(batch, batch_id, path, right_time, delay, **how)

    return both.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close_links(spark: SparkSession, path: str, right_time: str, **how) -> None:
    """Link the starts that still wait with what has been stored; for streams that have ended."""
    last, watermark = _before(spark, path, None)
    if last is None:
        return
    span = round((max(how["delta_minutes"], 0) + abs(how.get("cut_off_minutes", 0.0))) * MINUTE)
    schema = spark.read.parquet(f"{path}/targets/batch={last}").schema
    waiting = spark.read.parquet(f"{path}/waiting/batch={last}").where(~_closed(how["left_time"], span, watermark))
    _linked(waiting, path, schema, right_time, last, how).write.mode("overwrite").parquet(f"{path}/links/batch={last + 1}")


def alarms(stream: DataFrame, time: str, judge: str, operator: str, value, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Defect rate per window."""
    hit = OPERATORS[operator](F.col(judge), F.lit(value))
    windowed = stream.withWatermark(time, delay).groupBy(F.window(time, length))
    out = windowed.agg(F.count(judge).alias("n"), (F.count_if(hit) * 100.0 / F.nullif(F.count(judge), F.lit(0))).alias("ng_rate"))
    return out.select(F.col("window.start").alias("window_from"), "n", "ng_rate")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; results go to a folder."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start(path).awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Changed groups of each micro-batch go to a folder of their own, which a repeated batch replaces."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    query.trigger(availableNow=True).start().awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of every group written by ``run_updates``."""
    return first_rows(spark.read.parquet(path), keys, [("batch", "desc")]).drop("batch")
