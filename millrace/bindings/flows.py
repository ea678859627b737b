"""A1-A4, A17-A23 file round trips, import flow, L1-L8 streams.

Files are derived from the tables, written to the cluster's shared folder and read back by the operators.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.bindings.base import Registry, Tables, rounded
from millrace.bindings.links import SQL_ID, lineitem_with_id
from millrace.plans.importer import ImportSpec, import_batch
from millrace.plans.ingest import ingest_files, scan_columns
from millrace.session import shared_dir, written
from millrace.sources import files, store
from millrace.spec import LinkKey
from millrace.streaming import flows

R = Registry()


def scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/millrace/{name}-{uuid.uuid4().hex}"


def _csv(t: Tables, delimiter: str = ",") -> str:
    path = scratch(t, "csv")
    out = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"))
    out.write.option("header", True).option("sep", delimiter).csv(path)
    return path


LINE_TEXT = "l_orderkey::varchar as l_orderkey, l_linenumber::varchar as l_linenumber, l_quantity::varchar as l_quantity, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate"
R.add("A1_read_csv", lambda t: files.read_delimited(t.spark, _csv(t)), f"select {LINE_TEXT} from lineitem")
R.add("A1_read_tsv", lambda t: files.read_delimited(t.spark, _csv(t, "\t"), delimiter="\t"), f"select {LINE_TEXT} from lineitem")


SPLIT = {"spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "64k"}
NOTE = "'Order ' || l_orderkey || case l_orderkey % 4 when 0 then ', part \"' || l_partkey || '\"' when 1 then chr(10) || 'second line;' || chr(10) || ',' when 2 then '' else ' plain' end"


def _headed(lines: DataFrame, head: list[str]) -> DataFrame:
    """Lines (``value``) with ``head`` before those of each partition, so that every file written begins with it."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    return lines.mapInArrow(run, "value string")


def _noted(t: Tables, titles: list[str]) -> str:
    """Line items with a quoted note that holds delimiters, quotes and line ends; every file with its own title lines and header."""
    path = scratch(t, "noted")
    note = F.concat(F.lit('"'), F.replace(F.expr(NOTE), F.lit('"'), F.lit('""')), F.lit('"'))
    files_wanted = max(4, t.spark.sparkContext.defaultParallelism)
    lines = t.lineitem.repartition(files_wanted).select(F.concat_ws(",", "l_orderkey", "l_linenumber", note, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("value"))
    head = [*titles, "l_orderkey,l_linenumber,note,l_shipdate"]
    _headed(lines, head).write.text(path)
    return path


def _read_noted(titles: list[str]):
    def build(t: Tables):
        path = _noted(t, titles)
        before = {name: t.spark.conf.get(name) for name in SPLIT}
        for name, value in SPLIT.items():  # so that one file has several splits
            t.spark.conf.set(name, value)
        try:
            return written(files.read_delimited(t.spark, path, preamble=[*titles, "l_orderkey,l_linenumber,note,l_shipdate"] if titles else ()))
        finally:
            for name, value in before.items():
                t.spark.conf.set(name, value)

    return build


NOTED = f"select l_orderkey::varchar as l_orderkey, l_linenumber::varchar as l_linenumber, {NOTE} as note, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as l_shipdate from lineitem"
R.add("A1_read_quoted_line_ends", _read_noted([]), NOTED)
R.add("A1_read_quoted_line_ends_titled", _read_noted(["shipments, of the plant", "by order"]), NOTED)


def _described(t: Tables):
    out = files.describe_files(t.spark, _csv(t, ";"), "*.csv")
    return out.select("encoding", "delimiter", "skip", F.concat_ws(",", "header").alias("header")).distinct()


R.add(
    "A3_A4_describe_files",
    _described,
    "select 'utf-8' as encoding, ';' as delimiter, 0::int as skip, 'l_orderkey,l_linenumber,l_quantity,l_shipdate' as header",
)


def _transposed(t: Tables):
    """Nations with one line per field, read back as rows."""
    path = scratch(t, "transposed")
    df = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    cells = df.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("c"))
    rows = cells.groupBy(F.col("c.f").alias("f")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("c.v").alias("v")))).alias("vs"))
    rows.select(F.concat_ws(",", F.col("f"), F.transform("vs", lambda x: x["v"])).alias("line")).coalesce(1).write.text(path)
    cells = files.read_whole(t.spark, path, transpose=True, glob="*.txt")
    return files.cells_to_frame(cells, ["n_nationkey", "n_name", "n_regionkey"]).select("n_nationkey", "n_name", "n_regionkey")


R.add(
    "A2_read_transposed",
    _transposed,
    "select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation",
)


def _exported(t: Tables):
    path = scratch(t, "export")
    store.export_text(t.events.select("event_id", "ts", "value"), path, {"event_id": "No", "ts": "Time", "value": "Value [V]"}, ["ts"], "Asia/Tokyo", "\t")
    back = files.read_delimited(t.spark, path, delimiter="\t")
    return back.select(F.col("No").cast("long").alias("no"), F.col("Time").alias("at"), F.col("Value [V]").cast("double").alias("v"))


R.add(
    "A17_export_text",
    _exported,
    "select event_id as no, strftime(ts + interval '9 hours', '%Y-%m-%d %H:%M:%S.%g') as at, value as v from events",
)


def _zipped(t: Tables):
    """Zip files with display names, local times and the term; read back from all members."""
    path = scratch(t, "zip")
    lo, hi = datetime(2024, 1, 8), datetime(2024, 1, 22)
    rows = t.events.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).select("event_id", "ts", "value")
    shown = store.display_rows(rows, {"event_id": "No", "ts": "Time", "value": "Value"}, ["ts"], "Asia/Tokyo", (lo, hi))
    store.export_zip(shown.repartition(3), path, rows=1000)
    back = files.cells_to_frame(files.read_whole(t.spark, path, skip=0), shown.columns)
    return back.select(F.col("No").cast("long").alias("no"), F.col("Time").alias("at"), F.col("Value").try_cast("double").alias("v"), "term_from", "term_to")


R.add(
    "A17_export_zip_with_term",
    _zipped,
    """select event_id as no, strftime(ts + interval '9 hours', '%Y-%m-%d %H:%M:%S.%g') as at, value as v, '2024-01-08 09:00:00.000' as term_from, '2024-01-22 09:00:00.000' as term_to
from events where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22'""",
)


def _stored(t: Tables) -> tuple[str, DataFrame]:
    path = scratch(t, "rows")
    df = lineitem_with_id(t).select("l_id", "l_shipdate", "l_quantity")
    store.append_rows(df, path, "l_shipdate")
    return path, df


def _months(t: Tables):
    path, _ = _stored(t)
    return store.read_rows(t.spark, path, "l_shipdate", datetime(1997, 3, 15), datetime(1997, 6, 2)).select("l_id", "l_quantity")


R.add(
    "A18_A19_rows_by_month",
    _months,
    f"select {SQL_ID} as l_id, l_quantity from lineitem where l_shipdate >= timestamp '1997-03-15' and l_shipdate < timestamp '1997-06-02'",
)


def _restored(t: Tables):
    """Three days backed up; the table still holds the even ids, so the odd ones come back."""
    path = scratch(t, "backup")
    df = t.events.select("event_id", "ts", "value")
    store.backup_days(df, path, "ts")
    stored = df.where(F.col("event_id") % 2 == 0)
    return store.restore_days(stored, path, "ts", ["2024-01-05", "2024-01-06", "2024-01-09"])


R.add(
    "A20_backup_restore",
    _restored,
    "select event_id, ts, value from events where event_id % 2 = 1 and ts::date in (date '2024-01-05', date '2024-01-06', date '2024-01-09')",
)

# --- import ---


def _raw(t: Tables) -> DataFrame:
    """Events as a machine would deliver them: text, some unreadable, every tenth record twice."""
    k = F.col("event_id") % 10
    df = t.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(k == 3, "?").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"),
        F.when(k == 4, "NA").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(k == 4, F.lit(None)).otherwise(F.col("event_type")).alias("kind"),
    )
    return df.unionByName(df.where(F.col("id").cast("long") % 10 == 0))


IMPORT = ImportSpec("at", {"value": "REAL", "kind": "TEXT"}, keys=("id", "at", "value", "kind"), na_texts=("NA",))


def _imported(part: str):
    def build(t: Tables):
        stored = t.events.where(F.col("user_id") < 50).select(
            F.col("event_id").cast("string").alias("id"), F.date_trunc("second", "ts").alias("at"), "value", F.col("event_type").alias("kind")
        )
        return getattr(import_batch(_raw(t), IMPORT, stored), part)

    return build


R.add(
    "A21_import_good",
    _imported("good"),
    "select event_id::varchar as id, date_trunc('second', ts) as at, value, event_type as kind from events where event_id % 10 not in (3,4) and user_id >= 50",
)
R.add(
    "A21_import_errors",
    lambda t: _imported("errors")(t).select("id", "error_reason"),
    "select event_id::varchar as id, case event_id % 10 when 3 then 'no event time' else 'no readable value' end as error_reason from events where event_id % 10 in (3,4)",
)
R.add(
    "A21_import_duplicates",
    lambda t: _imported("duplicates")(t).select("id"),
    "select event_id::varchar as id from events where event_id % 10 = 0",
)


def _ingested(t: Tables):
    """Folder of CSV files → inferred types → import."""
    df = ingest_files(t.spark, _csv(t), "l_shipdate").good
    return df.groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("q"))


R.add(
    "A23_ingest_folder",
    _ingested,
    "select year(l_shipdate)::int as y, count(*) as n, sum(l_quantity) as q from (select distinct l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem) group by 1",
)


def _ingested_notes(t: Tables):
    df = ingest_files(t.spark, _noted(t, ["shipments of the plant"]), "l_shipdate", "*.txt").good
    return df.groupBy(F.year("l_shipdate").alias("y"), F.length("note").alias("note_size")).agg(F.count("*").alias("n"))


R.add(
    "A23_ingest_quoted_line_ends",
    _ingested_notes,
    f"select year(l_shipdate)::int as y, length(note)::int as note_size, count(*) as n from (select distinct l_orderkey, l_linenumber, {NOTE} as note, l_shipdate from lineitem) group by 1, 2",
)


FILE_ROWS = 1_000_000


def _numbered_rows(df: DataFrame) -> DataFrame:
    """Rows with their number ``_n`` from 0, partition after partition, from one count per partition."""
    counts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(counts):
        before[r["p"]], at = at, at + r["n"]
    offsets = F.coalesce(*[F.when(F.spark_partition_id() == p, F.lit(n)) for p, n in before.items()], F.lit(0)) if len(before) > 1 else F.lit(0)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_n", offsets + inside)


def _mixed_folder(t: Tables) -> str:
    """Files of different shapes: plain; other delimiter, title line and column order; Shift-JIS; two members in a zip."""
    path = scratch(t, "mixed")
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.col("l_quantity").cast("string").alias("l_quantity"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"),
    )
    part = F.pmod(F.col("l_orderkey").cast("long"), F.lit(4))
    rows.where(part == 0).write.option("header", True).csv(f"{path}/plain")
    # one file of a shape for each million line items, or less
    count = max(1, -(-t.lineitem.count() // FILE_ROWS))
    other = rows.where(part == 1).select(F.concat_ws(";", "l_shipdate", "l_quantity", "l_orderkey", "l_linenumber").alias("value"))
    other = other.coalesce(1) if count == 1 else other.repartition(count)
    _headed(other, ["shipments of the plant", "l_shipdate;l_quantity;l_orderkey;l_linenumber"]).write.text(f"{path}/titled")
    late = _numbered_rows(rows.where(part == 2)).withColumn("note", F.when(F.col("_n") > 1200, "計測値").otherwise("ok")).drop("_n")
    late = late.coalesce(1) if count == 1 else late
    late.write.option("header", True).option("encoding", "Shift_JIS").csv(f"{path}/japanese")

    def archive(batches):
        for number, batch in enumerate(batches):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                for member in (0, 1):
                    z.writestr(f"{member}.csv", batch[batch.index % 2 == member].to_csv(index=False))
            system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", target))
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/{TaskContext.get().partitionId()}-{number}.csv") as out:
                out.write(data.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    target = f"{path}/zipped" if "://" in path or path.startswith("file:") else f"file://{path}/zipped"
    rows.where(part == 3).mapInPandas(archive, "n long").agg(F.sum("n")).collect()
    return f"{path}/*"


def _ingested_mixed(part: str):
    def build(t: Tables):
        found = ingest_files(t.spark, _mixed_folder(t), "l_shipdate", "*.{csv,txt}")
        if part == "errors":
            return found.errors.agg(F.count("*").alias("n"))
        noted = F.count_if(F.col("note") == "計測値") > 0
        by = F.year("l_shipdate").alias("y")
        return found.good.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("q"), noted.alias("noted"))

    return build


R.add(
    "A23_ingest_mixed_folder",
    _ingested_mixed("good"),
    """select year(l_shipdate)::int as y, count(*) as n, sum(l_quantity) as q, true as noted from (select distinct l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem) group by 1""",
)
R.add("A23_ingest_mixed_errors", _ingested_mixed("errors"), "select count(*) as n from lineitem where l_orderkey is null")


def _scanned(t: Tables):
    df = t.part.select(F.concat(F.col("p_name"), F.lit("["), F.lower("p_type"), F.lit("]")).alias("data_name"))
    return scan_columns(df, "data_name").select("name", "unit")


R.add("flow_scan_names", _scanned, "select distinct p_name as name, lower(p_type) as unit from part")

# --- streams ---


def _events_stream(t: Tables) -> DataFrame:
    return flows.new_file_stream(t.spark, t.folder, t.events.schema, pathGlobFilter="events.parquet")


def _run(t: Tables, stream: DataFrame) -> DataFrame:
    path = scratch(t, "stream")
    flows.run_to_table(stream, f"{path}/out", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out")


def _updates(t: Tables, stream: DataFrame, keys) -> DataFrame:
    path = scratch(t, "stream")
    flows.run_updates(stream, f"{path}/out", f"{path}/checkpoint")
    return flows.latest_updates(t.spark, f"{path}/out", keys)


R.add(
    "L1_new_files",
    lambda t: _run(t, _events_stream(t).select("event_id", "value")),
    "select event_id, value from events",
)


def _import_stream(t: Tables):
    path = scratch(t, "import")
    raw = _raw(t)
    raw.write.parquet(f"{path}/in")
    stream = flows.new_file_stream(t.spark, f"{path}/in", raw.schema)
    flows.import_stream(stream, IMPORT, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return store.read_rows(t.spark, f"{path}/table/rows", "at")


R.add(
    "L2_import_stream",
    _import_stream,
    "select event_id::varchar as id, date_trunc('second', ts) as at, value, event_type as kind from events where event_id % 10 not in (3,4)",
)


def _imported_twice(t: Tables):
    """One batch imported, a second one, and the first again: what all four outputs hold."""
    path = scratch(t, "again")
    early = F.col("id").cast("long") % 2 == 0
    for number, part in ((0, early), (1, ~early), (0, early)):
        flows.import_micro_batch(_raw(t).where(part), number, IMPORT, path)
    counts = [t.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("output"), F.count("*").alias("n")) for name in ("rows", "errors", "duplicates")]
    hours = t.spark.read.parquet(f"{path}/counts")
    counts.append(hours.agg(F.lit("counts").alias("output"), F.sum(hours.columns[-2] if hours.columns[-1] == "batch" else hours.columns[-1]).alias("n")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


R.add(
    "L2_import_twice",
    _imported_twice,
    """with k as (select count(*) filter (event_id % 10 not in (3, 4)) as good, count(*) filter (event_id % 10 = 3) as bad, count(*) filter (event_id % 10 = 4) as empty,
count(*) filter (event_id % 10 = 0) as again from events)
select 'rows' as output, good as n from k union all select 'errors', bad + empty from k union all select 'duplicates', again from k union all select 'counts', good from k""",
)


def _imported_grown(t: Tables):
    """Batches with more and more columns; the last repeats rows of the others and brings rows that differ in a new column only."""
    path = scratch(t, "grown")
    raw = _raw(t).where(F.col("id").cast("long") % 10 < 3).drop("kind").withColumn("unit", F.lit("mm"))
    first, other = F.col("id").cast("long") % 2 == 0, F.col("unit") == "in"
    later = raw.unionByName(raw.withColumn("unit", F.lit("in"))).withColumn("line", F.lit("A"))
    spec = ImportSpec("at", {"value": "REAL"})
    for number, batch in enumerate((raw.where(first).drop("unit"), raw.where(~first), later.where(other | ~first).drop("line"), later.where(other), raw.where(first).drop("unit"))):
        flows.import_micro_batch(batch, number, spec, path)
    return store.read_rows(t.spark, f"{path}/rows", "at").select("id", "value", "unit", "line")


R.add(
    "L2_A18_import_grown_columns",
    _imported_grown,
    """with e as (select event_id::varchar as id, value, event_id % 2 = 0 as first from events where event_id % 10 < 3)
select id, value, null::varchar as unit, null::varchar as line from e where first union all select id, value, 'mm', null from e where not first
union all select id, value, 'in', null from e union all select id, value, 'in', 'A' from e""",
)


def _rows_grown(t: Tables):
    """A table whose second part has a column that the first lacks, and whose third lacks one."""
    path = scratch(t, "grown")
    df = lineitem_with_id(t).select("l_id", "l_shipdate", "l_quantity", "l_tax")
    for rest, gone in ((0, ["l_tax"]), (1, []), (2, ["l_quantity"])):
        store.append_rows(df.where(F.col("l_id").cast("long") % 3 == rest).drop(*gone), path, "l_shipdate")
    return store.read_rows(t.spark, path, "l_shipdate", datetime(1997, 3, 15), datetime(1997, 6, 2)).select("l_id", "l_quantity", "l_tax")


R.add(
    "A18_A19_grown_columns",
    _rows_grown,
    f"""select l_id, case when l_id % 3 <> 2 then l_quantity end as l_quantity, case when l_id % 3 <> 0 then l_tax end as l_tax
from (select {SQL_ID} as l_id, * from lineitem) where l_shipdate >= timestamp '1997-03-15' and l_shipdate < timestamp '1997-06-02'""",
)


def _counted_down(t: Tables):
    """Every event is added, and every third one deleted again."""
    path = scratch(t, "changes")
    added = t.events.select("ts", "event_type", F.lit(1).alias("change"))
    gone = t.events.where(F.col("event_id") % 3 == 0).select("ts", "event_type", F.lit(-1).alias("change"))
    added.unionByName(gone).write.parquet(path)
    stream = flows.new_file_stream(t.spark, path, added.schema)
    return _updates(t, flows.hourly_counter(stream, "ts", ["event_type"], change="change"), ["hour", "event_type"])


R.add(
    "L4_hourly_counter_down",
    _counted_down,
    "select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) filter (event_id % 3 <> 0) as n from events group by 1, 2",
)


def _no_repeats(t: Tables):
    path = scratch(t, "twice")
    df = t.events.select("event_id", "ts", "value")
    df.unionByName(df.where(F.col("event_id") % 3 == 0)).write.parquet(path)
    return _run(t, flows.without_repeats(flows.new_file_stream(t.spark, path, df.schema), "ts", ["event_id"]))


R.add("L3_without_repeats", _no_repeats, "select event_id, ts, value from events")
R.add(
    "L4_hourly_counter",
    lambda t: _updates(t, flows.hourly_counter(_events_stream(t), "ts", ["event_type"]), ["hour", "event_type"]),
    "select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n from events group by 1, 2",
)
R.add(
    "L5_cyclic_windows",
    lambda t: rounded(_updates(t, flows.cyclic_windows(_events_stream(t), "ts", "value", "12 hours", "6 hours"), ["term_from"]), "mean"),
    """with w as (select time_bucket(interval '6 hours', ts) - to_hours((6*i)::int) as f, value from events, range(2) r(i))
select f as term_from, f + interval '12 hours' as term_to, count(value) as n, round(avg(value),6) as mean from w group by 1, 2""",
)


def _linked_streams(t: Tables):
    """Errors and purchases arrive in five batches, every purchase one batch after the errors of its time or later."""
    path = scratch(t, "link")
    starts = t.events.where("event_type = 'error'").select(F.col("event_id").alias("err_id"), F.col("user_id").alias("err_user"), F.col("ts").alias("err_ts"))
    targets = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("buy_user"), F.col("ts").alias("buy_ts"))
    low, high = t.events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 4
    period = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) / (step / timedelta(microseconds=1)))
    late = (period + 1 + (F.col("buy_id") % 5 == 0).cast("int")).alias("arrival")
    starts.withColumnRenamed("err_ts", "ts").select("*", period.alias("arrival")).withColumnRenamed("ts", "err_ts").write.partitionBy("arrival").parquet(f"{path}/starts")
    targets.withColumnRenamed("buy_ts", "ts").select("*", late).withColumnRenamed("ts", "buy_ts").write.partitionBy("arrival").parquet(f"{path}/targets")
    how = {"left_time": "err_ts", "right_time": "buy_ts", "delta_minutes": 600, "cut_off_minutes": 480, "keys": [LinkKey("err_user", "buy_user")]}
    for arrival in range(7):
        for name, df in (("starts", starts), ("targets", targets)):
            came = t.spark.read.parquet(f"{path}/{name}").where(F.col("arrival") == arrival).drop("arrival")
            came.write.mode("append").parquet(f"{path}/in/{name}")
        streams = [flows.new_file_stream(t.spark, f"{path}/in/{name}", df.schema) for name, df in (("starts", starts), ("targets", targets))]
        flows.link_streams(*streams, f"{path}/out", f"{path}/checkpoint", delay=step, **how).awaitTermination()
    flows.close_links(t.spark, f"{path}/out", **how)
    return t.spark.read.parquet(f"{path}/out/links").select("err_id", "buy_id")


R.add(
    "L6_time_link_stream",
    _linked_streams,
    """with e as (select event_id as err_id, user_id as eu, ts as et from events where event_type = 'error'),
b as (select event_id as buy_id, user_id as bu, ts as bt from events where event_type = 'purchase'),
j as (select err_id, buy_id, abs(epoch_us(bt) - epoch_us(et) - 36000000000) as d from e left join b on eu = bu and bt > et
  and epoch_us(bt) < epoch_us(et) + 64800000000 and epoch_us(bt) > epoch_us(et) + 7200000000)
select err_id, buy_id from j qualify rank() over (partition by err_id order by d) = 1""",
)
R.add(
    "L8_alarms",
    lambda t: rounded(_updates(t, flows.alarms(_events_stream(t), "ts", "value", ">", 50, "1 day"), ["window_from"]), "ng_rate"),
    "select date_trunc('day', ts)::timestamp as window_from, count(value) as n, round(count(*) filter (value > 50)*100.0/count(value),6) as ng_rate from events group by 1",
)
