"""The equation catalogue on small tables."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.equations import CATALOGUE, ORDERED_IDS, SELF_IDS, EquationSpec, frame_labels
from millrace.operators.derive import apply_equations, discretise, others, significant

INF = float("inf")


def run(spark, values, kind, **spec):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)],
                               "id long, x " + kind if not isinstance(values[0], tuple) else f"id long, x {kind}, y {kind}")
    out = apply_equations(df, [EquationSpec(x="x", out="r", **spec)], order=["id"])
    return [r["r"] for r in out.orderBy("id").collect()]


CASES = [
    ("double", [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 2.0)], {"fn": 13, "y": "y", "a": 1, "b": 1, "c": 1}, [INF, -INF, None, 4.0]),
    ("double", [100.0, 0.0, -1.0, None], {"fn": 16, "a": 2, "b": 0, "c": 1}, [5.0, -INF, None, None]),
    ("string", ["ff", "0x1F", " -a ", "1G", "", None, "1_0"], {"fn": 20}, [255, 31, -10, None, None, None, 16]),
    ("string", ["5", "0", "-5", "zz"], {"fn": 21}, ["101", "0", "b101", None]),
    ("string", ["2", "1", "x"], {"fn": 22, "n": 2}, [True, False, None]),
    ("string", ["ab1c", "ab2c", "a"], {"fn": 30, "n": 2, "k": 3, "t": "Str"}, ["b1", "b2", None]),
    ("string", ["ab1c", "xy"], {"fn": 30, "n": -2, "k": -1, "t": "Str"}, ["1c", "xy"]),
    ("string", ["abcd"], {"fn": 30, "n": 1, "k": -2, "t": "Str"}, ["abc"]),
    ("string", ["20240305123456.5", "nope"], {"fn": 40}, [datetime(2024, 3, 5, 12, 34, 56, 500000), None]),
    ("string", ["a", "b", None], {"fn": 50, "x_type": "text", "s": "a|b", "t": "!="}, [True, True, None]),
    ("long", [1, 2, None], {"fn": 50, "x_type": "int", "s": "1|2.5", "t": "=="}, [True, False, None]),
    ("boolean", [(True, None), (True, False), (None, False)], {"fn": 55, "y": "y"}, [None, True, None]),
    ("boolean", [(False, None), (True, True)], {"fn": 56, "y": "y"}, [None, True]),
    ("string", ["EQ1ST", "none"], {"fn": 60, "x_type": "text", "t": "Int"}, [1, None]),
    ("string", ["ab12", "cd"], {"fn": 60, "x_type": "text", "s": r"(?P<a>[a-z]+)(\d+)", "t": "Str"}, ["ab|12", None]),
    ("string", ["S", "ab1", "cd2"], {"fn": 61, "x_type": "text", "s": "S", "t": "Str"}, [None, "ab1", "cd2"]),
    ("string", ["a-b"], {"fn": 62, "x_type": "text", "s": "(a)-(b)", "t": r"\2$\1"}, ["b$a"]),
    ("string", [("", "y"), ("x", "y"), ("", "")], {"fn": 70, "y": "y", "x_type": "text", "y_type": "text", "t": "Str"}, ["y", "x", None]),
    ("boolean", [True, False, None], {"fn": 71, "x_type": "bool", "s": "true|false", "t": "OK|NG"}, ["OK", "NG", None]),
    ("string", ["1", "2", "3"], {"fn": 71, "x_type": "text"}, ["OK", "NG", "3"]),
    ("string", ["1.0", "1.5", "x", "7"], {"fn": 72, "x_type": "text", "t": "Int"}, [1, None, None, 7]),
    ("boolean", [True, False], {"fn": 72, "x_type": "bool", "t": "Str"}, ["true", "false"]),
    ("double", [1.0, 2.0, 3.0], {"fn": 80, "x_type": "real", "s": "9", "t": "1"}, [9.0, 1.0, 2.0]),
    ("double", [1.0, None, 3.0], {"fn": 90, "x_type": "real", "t": "b"}, [1.0, 1.0, 3.0]),
    ("double", [None, 2.0, None], {"fn": 90, "x_type": "real", "t": "fc", "s": "0"}, [2.0, 2.0, 0.0]),
    ("double", [1.2, 9999.0, 9.999, 1.3], {"fn": 120, "x_type": "real", "a": 9999, "b": 9.999}, [1.2, None, None, 1.3]),
    ("double", [0.1, 8.2, 2.0, 7.3], {"fn": 121, "x_type": "real", "a": 0, "b": 2}, [None, 8.2, None, 7.3]),
    ("double", [0.1, 8.2, 2.0, 7.3], {"fn": 122, "x_type": "real", "a": 0, "b": 2}, [0.1, None, 2.0, None]),
    ("string", ["S", "ab1", "S"], {"fn": 131, "x_type": "text", "s": "S", "t": "Str"}, [None, "ab1", None]),
]


@pytest.mark.parametrize("kind,values,spec,want", CASES)
def test_case(spark, kind, values, spec, want):
    assert run(spark, values, kind, **spec) == want


def test_time_frame(spark):
    at = [datetime(2022, 6, 10, 19, 11, 22), datetime(2022, 6, 10, 9, 30), datetime(2022, 6, 10, 1, 30), datetime(2022, 6, 10, 2)]
    assert run(spark, at, "timestamp", fn=43, a=9.5, b=8) == ["17:30-25:30", None, "17:30-25:30", "01:30-09:30"]
    assert [label for _, _, label in frame_labels(0, 9)] == ["00:00-09:00", "09:00-18:00", "18:00-24:00"]


def test_format_output_type(spark):
    at = [datetime(2024, 3, 5, 1)]
    assert run(spark, at, "timestamp", fn=42, s="%Y%m%d") == [20240305]
    assert run(spark, at, "timestamp", fn=42, s="%d.%m") == ["05.03"]


def test_combine(spark):
    df = spark.createDataFrame([(1, 2), (3, None)], "x long, y long")
    spec = EquationSpec(32, "x", "y", "r", x_type="int", y_type="int", s="Eq{:02d}-St{:01d}", t="Str")
    assert [r["r"] for r in apply_equations(df, [spec]).collect()] == ["Eq01-St2", None]
    spec = EquationSpec(32, "x", "y", "r", x_type="int", y_type="int", s="{}/{}", t="Str")
    assert [r["r"] for r in apply_equations(df, [spec]).collect()] == ["1/2", "3/"]


def test_type_mismatch(spark):
    with pytest.raises(ValueError):
        run(spark, [("a", "b")], "string", fn=70, y="y", x_type="text", y_type="int")


def test_catalogue_is_complete():
    ids = {*range(10, 17), 20, 21, 22, 28, 29, 30, 32, *range(40, 49), 50, 51, 55, 56, 60, 61, 62, 70, 71, 72, 80, 90, 120, 121, 122, 131}
    assert {*CATALOGUE, *ORDERED_IDS} == ids
    assert set(SELF_IDS.values()) <= ids


def test_discretise_example(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    assert sorted(r["x"] for r in discretise(df, "x", 2).collect()) == [0.5, 0.5, 2.5, 2.5]
    assert sorted(r["x"] for r in discretise(df, "x", 4).collect()) == [0.0, 1.0, 2.0, 3.0]


def test_others(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbcd"] + [(None,)], "c string")
    got = {r["g"]: r["count"] for r in others(df, "c", "g", keep=3).groupBy("g").count().collect()}
    assert got == {"a": 3, "b": 2, "Other": 2, None: 1}


def test_significant(spark):
    df = spark.createDataFrame([(123456.0,), (0.00123456,), (0.0,), (-9.99996,)], "x double")
    got = [r["r"] for r in df.select(significant(F.col("x")).alias("r")).collect()]
    assert all(math.isclose(a, b) for a, b in zip(got, [123500.0, 0.001235, 0.0, -10.0]))
