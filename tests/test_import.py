"""Cleaning, import and reshape on small tables."""

import pathlib
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.bindings import flows as flows_bindings
from millrace.bindings.base import Tables
from millrace.functions import names, repair
from millrace.operators import cleaning, reshape
from millrace.plans import importer
from millrace.sources import files, profile, tables
from millrace.streaming import flows


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["r"] for r in df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]


def test_merge_example(spark, buckets):
    left = spark.createDataFrame([(i, a, a) for i, a in enumerate([2, 2, 3, 3])], "i int, a int, b int")
    right = spark.createDataFrame([(i, a, a, c) for i, (a, c) in enumerate([(2, "x"), (2, "y"), (3, "z")])], "i int, a int, b int, c string")
    right = right.withColumnRenamed("i", "j")
    out = importer.merge_by_position(left, right, ["a", "b"], ["i"], ["j"], ["c"])
    assert [r["c"] for r in out.orderBy("i").collect()] == ["x", "y", "z", None]


def test_flags():
    assert importer.done_flag("v2_measurement") == 3 and importer.missing_flag("efa_history") == 4
    assert importer.missing_flag("general") is None and importer.done_flag("general") == 0


def test_sentinels(spark):
    df = spark.createDataFrame([(9999, 9999.0, "----"), (-99999, -9999.9, "abc"), (1111, 99.999, "9999"), (12, 0.0, "7"), (5, 12345678.0, None)],
                               "i int, r double, t string")
    out = cleaning.replace_sentinels(df, ["i", "r", "t"]).collect()
    assert [r["i"] for r in out] == [None, None, None, 12, 5]
    assert [r["r"] for r in out] == [float("inf"), float("-inf"), float("inf"), 0.0, 12345678.0]
    assert [r["t"] for r in out] == [None, "abc", None, "7", None]


def test_dates(spark):
    fixed = column(spark, ["01-02", "24/3/5", "2024年3月5日", "2024年3月5日12時34分56秒", "2020-01-01 10:00:00"], lambda c: repair.repair_datetime(c, 2026))
    assert fixed == ["2026-01-02 00:00:00", "2024-3-5 00:00:00", "2024-3-5 00:00:00", "2024-3-5 12:34:56", "2020-01-01 10:00:00"]
    assert column(spark, ["24.3.5", "2024/02/30", "x"], repair.repair_date) == ["2024-03-05", None, None]
    assert column(spark, ["12時3分4秒", "12.3.4", "12 30 09", "nope"], repair.repair_time) == ["12:03:04", "12:03:04", "12:30:09", None]


def test_numbers(spark):
    assert column(spark, ["1,5", "1.234,5", "1 234,5"], lambda c: repair.european_number(c, "eu_real_sep")) == [1.5, 1234.5, 1234.5]
    assert column(spark, ["1,234.5"], lambda c: repair.european_number(c, "real_sep")) == [1234.5]
    df = spark.createDataFrame([("Inf",), ("#DIV/0!",), ("'12'",), ("NA",), ("oops",), ("-1/0",)], "x string")
    out = cleaning.validate(df, {"x": "REAL"}).collect()
    assert [r["x"] for r in out] == [float("inf"), float("inf"), 12.0, None, None, float("-inf")]
    assert [r["is_error"] for r in out] == [False, False, False, False, True, False]


def test_normalise(spark):
    assert column(spark, ["ＡＢ　 ｃ", " 25°C ", "➓➋", "plain", None], repair.normalise_text) == ["AB c", "25℃", "102", "plain", None]


def test_types(spark):
    rows = [(str(i), f"{i}.5", "2024-01-01 00:00:00", "true" if i % 2 else "false", f"kind{i % 3}", "0" if i % 2 else "1", f"00{i:010d}", str(10**12 + i)) for i in range(40)]
    cols = ["n", "r", "d", "b", "c", "bit", "z", "big"]
    got = profile.infer_types(spark.createDataFrame(rows, cols), cols)
    assert got == {"n": "SMALL_INT", "r": "REAL", "d": "DATE", "b": "BOOLEAN", "c": "CATEGORY", "bit": "BOOLEAN", "z": "TEXT", "big": "BIG_INT"}


def test_import_keeps_every_row(spark, buckets):
    rows = [(str(i), "2024-01-01 00:00:0" + str(i % 10) if i % 5 else "bad", "1.5" if i % 3 else None) for i in range(30)]
    raw = spark.createDataFrame(rows + rows[:10], "id string, at string, v string")
    spec = importer.ImportSpec("at", {"v": "REAL"})
    out = importer.import_batch(raw, spec)
    n = {k: getattr(out, k).count() for k in ("good", "errors", "duplicates")}
    assert sum(n.values()) == raw.count()
    assert out.counts.agg(F.sum("n")).first()[0] == n["good"]
    again = importer.import_batch(raw, spec, stored=out.good)
    assert again.good.count() == 0


def test_import_stream_is_idempotent(spark, tmp_path):
    raw = spark.createDataFrame([(str(i), f"2024-01-01 00:00:{i:02d}", "1") for i in range(20)], "id string, at string, v string")
    spec = importer.ImportSpec("at", {"v": "REAL"})
    for part in ("a", "b"):  # the same records are delivered twice
        raw.write.mode("append").parquet(f"{tmp_path}/in")
        stream = flows.new_file_stream(spark, f"{tmp_path}/in", raw.schema)
        flows.import_stream(stream, spec, f"{tmp_path}/table", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table/rows").count() == 20


def test_updates_of_several_batches(spark, tmp_path):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, i),) for i in range(30)], "ts timestamp")
    for _ in range(3):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = flows.new_file_stream(spark, f"{tmp_path}/in", df.schema, max_files=1)
    flows.run_updates(flows.hourly_counter(stream, "ts"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [tuple(r) for r in flows.latest_updates(spark, f"{tmp_path}/out", ["hour"]).collect()] == [(datetime(2024, 1, 1), 90)]


def test_file_head(tmp_path, spark):
    assert files.guess_delimiter(["a;b", "1;2", "3;4", "5;6"]) == ";"
    assert files.guess_encoding("計測".encode("shift_jis")) == "shift_jis"
    assert files.guess_encoding("計測".encode()[:5]) == "utf-8"
    assert files.split_unit("load [N]") == ("load", "N")
    path = tmp_path / "m.csv"
    path.write_text("made by machine\n\na,b\n1,2\n3,4\n", encoding="utf-8")
    row = files.describe_files(spark, str(path)).first()
    assert (row["delimiter"], row["skip"], row["header"]) == (",", 2, ["a", "b"])
    path.write_text("made by machine\n\na,b\n1,2\n3\n", encoding="utf-8")
    df = files.read_delimited(spark, str(path), delimiter=",", preamble=row["preamble"])
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [("1", "2"), ("3", None)]


def test_known_layout():
    text = ["検索期間,2024", "ライン,L1", "工程,P1", "設備,m1,,m2", "特性名,a,b,c", ",N,mm,s", ",x,y,z"]
    got = files.known_layout(text, ",")
    assert got["machine"] == ["", "m1", "m1", "m2"] and got["unit"] == ["", "N", "mm", "s"] and got["line"][0] == "L1"
    assert files.known_layout(["a,b", "1,2"], ",") is None


def test_zip_file(tmp_path, spark):
    import zipfile

    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", "a,b\n1,2\n3,4\n")
    cells = files.read_whole(spark, str(tmp_path / "d.zip"))
    assert sorted(tuple(r)[2:] for r in files.cells_to_frame(cells, ["a", "b"]).collect()) == [("1", "2"), ("3", "4")]


def test_pull_windows():
    now = datetime(2024, 1, 10)
    assert tables.pull_window("past", datetime(2024, 1, 5), None, now)[1] == datetime(2024, 1, 5)
    span = tables.next_span(tables.timedelta(hours=12), 10_000, 10_000)
    assert span == tables.timedelta(hours=6)
    assert len(tables.range_predicates("t", tables.time_ranges(datetime(2024, 1, 1), datetime(2024, 1, 3)))) == 2
    assert tables.jdbc_options("postgresql", "u", "t", ("id", "0", "9", 4))["numPartitions"] == "4"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("△q/△SP荷重 [mm3/str/N]", ("△q/△SP荷重", "mm3/str/N")),
        ("AJP圧入荷重[N](最終荷重)", ("AJP圧入荷重 最終荷重", "N")),
        ("SPバネ定数[N]]", ("SPバネ定数", "N")),
        ("切込み終了時荷重（ﾛｰﾗ①実測）[N", ("切込み終了時荷重（ﾛｰﾗ①実測）", "N")),
        ("AJP圧入荷重[N][mm](最終荷重)", ("AJP圧入荷重 最終荷重", "N")),
        ("計測値:荷重(kN)", ("荷重", "kN")),
    ],
)
def test_data_names(spark, raw, want):
    got = column(spark, [raw], lambda c: names.data_name(c, ["kN", "mm"]))[0]
    assert (got["name"], got["unit"]) == want


def test_line_names(spark):
    raw = ["調整検査6号", "直噴INJ ボデーCKD1号ライン", "直噴INJ ボデー研削 前加工ライン", "直噴INJ4号 バルブASSY組付ライン", "Line A"]
    got = column(spark, raw, names.line_name)
    assert [(g["line"], g["line_no"]) for g in got] == [("調整検査", "6"), ("ボデーCKD", "1"), ("ボデー研削 前加工", None), ("バルブASSY組付", "4"), ("Line A", None)]


def test_equipment(spark):
    got = column(spark, ["AS-9235", "IMB-4488-2", "CTXX1212", "0303_DIAC5-JP-SCR02_IMB-4495-01", "?"], names.equipment_id)
    assert [tuple(g) for g in got] == [("ASXX-9235", None), ("IMBX-4488", 2), ("CTXX-1212", None), ("IMBX-4495", 1), ("?", None)]
    got = column(spark, ["油密検査機1号1ST", "動的流量調整検査2号機2ST", "静的流量検査機"], names.equipment_name)
    assert [tuple(g) for g in got] == [("油密検査", "1", "1"), ("動的流量調整検査", "2", "2"), ("静的流量検査", None, None)]
    got = column(spark, ["JP2995003240", "324"], names.part_number)
    assert [tuple(g) for g in got] == [("JP2995003240", "299500", "324", "JP"), ("JP0000003240", "000000", "324", "JP")]


def test_sub_parts(spark):
    df = spark.createDataFrame([(1, "JP1234567890", "t", "l", "s"), (2, None, "t", "l", "s")], "id int, p string, tray string, lot string, ser string")
    got = {(r["data_name"], r["data_value"]) for r in reshape.sub_part_history(df, "p", "tray", "lot", "ser").collect()}
    assert got == {("SUB_TRAY_NO_123456", "t"), ("SUB_LOT_NO_123456", "l"), ("SUB_SERIAL_123456", "s")}
    wide = spark.createDataFrame([(1, "JP1234567890", "L1")], "id int, Ko1Shinaban string, Ko1Lot string")
    got = {tuple(r)[1:] for r in reshape.repeated_groups(wide, ["id"], 1).collect()}
    assert got == {("Sub1Part", "7890"), ("Sub1Lot", "L1")}


def test_unique_names():
    assert reshape.number_names(["a", "a", "b", "a", "a_01"]) == ["a", "a_02", "b", "a_03", "a_01"]


def test_equal_rows_are_counted_not_sorted(spark):
    df = spark.createDataFrame([("a", 0.0, None)] * 3 + [("a", 1.0, "x"), (None, float("nan"), None), (None, float("nan"), None), ("b", -0.0, "y")], "k string, v double, t string")
    kept, dropped = importer.repeated_rows(df, ["k", "v", "t"], [])
    rows = lambda d: sorted(str(tuple(r)) for r in d.collect())
    assert rows(kept) == sorted(["('a', 0.0, None)", "('a', 1.0, 'x')", "(None, nan, None)", "('b', -0.0, 'y')"])
    assert rows(dropped) == sorted(["('a', 0.0, None)"] * 2 + ["(None, nan, None)"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    many = spark.range(9001).select(F.lit("a").alias("k"))
    kept, dropped = importer.repeated_rows(many, ["k"], [])
    assert (kept.count(), dropped.count()) == (1, 9000)


def test_facts_read_each_value_once(spark):
    df = spark.createDataFrame([("1", None), ("1", " x"), ("2.5", "x"), (None, "007")], "a string, b string")
    facts = {r["column"]: r.asDict() for r in profile.column_facts(df.withColumn("c", F.lit(None).cast("string")), ["a", "b", "c"]).collect()}
    assert [facts["a"][k] for k in ("known", "numbers", "whole", "bits", "plain_ints", "distinct", "longest")] == [3, 3, 2, 2, 2, 2, 3]
    assert [facts["b"][k] for k in ("known", "numbers", "double_zero", "distinct")] == [3, 1, 1, 2]
    assert set(facts["c"].values()) == {"c", 0}


def test_events_are_not_broadcast(spark):
    """Events grow with the measures: tasks hash their share of them."""
    measures = spark.createDataFrame([(1, 1, "q", "5"), (2, 1, "q", "6"), (3, 9, "q", "7"), (4, None, "q", "8")], "id int, event int, data_name string, data_value string")
    events = spark.createDataFrame([(1, 7), (2, 7), (None, 7)], "event int, equip int")
    equips = spark.createDataFrame([(7, 3)], "equip int, line int")
    lines = spark.createDataFrame([(3, "L")], "line int, name string")
    out = tables.measurement_records(measures, events, equips, lines, {"event": "event", "equip": "equip", "line": "line"})
    assert sorted((r["id"], r["name"]) for r in out.collect()) == [(1, "L"), (2, "L")]
    assert "ShuffledHashJoin [event" in out._jdf.queryExecution().executedPlan().toString()


def test_members_side_by_side(spark, tmp_path):
    """The same rows as from cells put together by row, without a shuffle."""
    with zipfile.ZipFile(tmp_path / "a.csv", "w") as z:
        z.writestr("0.csv", "id,x,x\n1,a\n\n2,b,c,more\n")
        z.writestr("1.csv", "y;id\nz;3\n;4\n")
        z.writestr("2.csv", "")
    fields = ["id", "x", "x_1", "y"]
    whole = files.read_whole(spark, str(tmp_path), skip=None)
    fields += [r["field"] for r in whole.select("field").distinct().collect() if r["field"] not in fields]
    out = files.read_members(spark, str(tmp_path), fields, skip=None)
    want = files.cells_to_frame(whole, fields).drop("path", "row")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 4
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_large_mixed_folder_has_many_files(spark, sf, monkeypatch):
    """No file of the mixed folder takes a fixed share of the table; rows and notes are the same for any number of files."""
    plain = flows_bindings._ingested_mixed("good")(Tables(spark, sf)).collect()
    monkeypatch.setattr(flows_bindings, "FILE_ROWS", 2000)
    t = Tables(spark, sf)
    assert len(list(pathlib.Path(flows_bindings._mixed_folder(t).removesuffix("/*") + "/titled").glob("*.txt"))) >= 3
    assert sorted(flows_bindings._ingested_mixed("good")(t).collect()) == sorted(plain)


def test_numbered_rows(spark):
    df = flows_bindings._numbered_rows(spark.range(0, 1000, 1, 7).where("id % 3 <> 0"))
    rows = df.orderBy("id").collect()
    assert [r["_n"] for r in rows] == list(range(len(rows)))


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    """Tasks grow in number, not in size: for counting equal rows and for counting values."""
    monkeypatch.setattr(importer, "COUNTED_ROWS", 100)
    df = spark.range(0, 1000, 1, 2).selectExpr("id % 700 as k", "double(id % 7) as v")
    kept, dropped = importer.repeated_rows(df, df.columns, [])
    assert (kept.count(), kept.distinct().count(), dropped.count()) == (700, 700, 300)
    assert "hashpartitioning(k" in kept._jdf.queryExecution().executedPlan().toString() and kept.rdd.getNumPartitions() == 10
    sizes = [r["n"] for r in session.dealt(df, 100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 250 and session.dealt(df, 500) is df
