"""Records with line ends in quoted values against Python's csv module, over many small splits."""

import csv
import io
import random

import pyarrow as pa
import pytest

from millrace.plans.ingest import read_folder
from millrace.sources import files, records

SPLITS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]


@pytest.fixture(params=["128m", "700"], ids=["whole", "splits"])
def split_size(request, spark):
    for name in SPLITS:
        spark.conf.set(name, request.param)
    yield request.param
    for name in SPLITS:
        spark.conf.unset(name)


def rows(seed, n):
    """Values with delimiters, doubled quotes, line ends and quotes inside bare values; some run over many splits."""
    rng = random.Random(seed)
    parts = ["a", "b,c", 'say ""x""', "line\nend", "two\n\nlines", ' 5" pipe', "計測", '"', "\n", ",\n,", ""]
    out = []
    for i in range(n):
        cells = ["".join(rng.choice(parts) for _ in range(rng.randrange(4))) for _ in range(2)]
        if i % 37 == 5:
            cells[0] = "\n".join(f"long {j}, \"quoted\"" for j in range(200))
        out.append((str(i), *cells))
    return out


def quoted(value, rng):
    if any(c in value for c in ',\n"') and not (value.startswith(" ") and "," not in value and "\n" not in value) or rng.random() < 0.2:
        return '"' + value.replace('"', '""') + '"'
    return value


def text(data, seed, titles):
    rng = random.Random(seed)
    lines = [*titles, "id,x,y"] + [",".join(quoted(v, rng) for v in r) for r in data]
    return "\n".join(lines) + "\n"


def clean(v):
    return v or None


@pytest.mark.parametrize("titles", [[], ["plant A, line 3", 'with a "', "id of the file"]], ids=["plain", "titles"])
def test_records_against_csv(spark, tmp_path, split_size, titles):
    want = []
    for k in range(3):
        data = rows(k, 60)
        if titles:
            data.append(tuple(titles[:1]) + ("", ""))  # a data line like a title line stays
        body = text(data, k, titles)
        (tmp_path / f"{k}.csv").write_bytes(body.encode())
        want += [tuple(clean(v) for v in r) for r in list(csv.reader(io.StringIO("\n".join(body.split("\n")[len(titles) :]))))[1:]]
    preamble = [*titles, "id,x,y"] if titles else []
    out = files.read_delimited(spark, str(tmp_path), preamble=preamble)
    got = [tuple(clean(v) for v in r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert out.columns == ["id", "x", "y"]


def test_title_lines_by_position(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_text("title\nid,x\n1,a\ntitle\nid,x\n2,b\n\n")
    got = files.read_delimited(spark, str(tmp_path), preamble=["title", "id,x"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("1", "a"), ("title", None), ("id", "x"), ("2", "b")], key=str)


def test_state_of_lines():
    rng = random.Random(9)
    for _ in range(3000):
        line = "".join(rng.choice('a",') for _ in range(rng.randrange(12)))
        for inside in (False, True):
            state, fresh, i = inside, not inside, 0
            while i < len(line):
                c = line[i]
                if state:
                    if c == '"':
                        if line[i + 1 : i + 2] == '"':
                            i += 1
                        else:
                            state = False
                elif c == ",":
                    fresh = True
                    i += 1
                    continue
                elif c == '"' and fresh:
                    state = True
                fresh = False
                i += 1
            assert records.inside_after(line, ",", inside) == state, (line, inside)


@pytest.mark.parametrize("delimiter", [",", "||"])
def test_states_of_batches(delimiter):
    rng = random.Random(3)
    for _ in range(300):
        lines = ["".join(rng.choice(["a", '"', '"', delimiter, "計"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 30))]
        batch = pa.array(["x", *lines])[1:]  # a part of a larger one
        for inside in (False, True):
            want = [inside]
            for line in lines:
                want.append(records.inside_after(line, delimiter, want[-1]))
            assert records.Quotes(batch, delimiter).states(inside).tolist() == want, lines


def test_few_lines_are_looked_at_one_by_one(monkeypatch):
    """Regular quotes, also doubled ones and delimiters in values, are counted a batch at a time."""
    seen = []
    known = records.inside_after
    monkeypatch.setattr(records, "inside_after", lambda *a: seen.append(a) or known(*a))
    lines = pa.array(['1,"a, ""b""",x', '2,"two', 'lines;', ',",y', '3,"",z', '4,bare 5" pipe,z'] * 100)
    states = records.Quotes(lines, ",").states(False).tolist()
    assert states == [False, False, True, True, False, False] * 100 + [False]
    assert len(seen) == 100


def test_small_splits_share_tasks(spark, tmp_path):
    """A task reads several small splits; their number does not grow with the text."""
    (tmp_path / "a.csv").write_text('id,note\n' + '1,"two\nlines"\n' * 20_000)
    for name in SPLITS:
        spark.conf.set(name, "700")
    try:
        lines = records._lines(spark, str(tmp_path), "UTF-8")
        assert lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert lines.select("block").distinct().count() > 300
        assert records.read_records(spark, str(tmp_path)).count() == 20_001
    finally:
        for name in SPLITS:
            spark.conf.unset(name)


def test_folder_with_line_ends(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    (tmp_path / "b.csv").write_text('id,note\n3,"a, b"\n')
    got = {r["id"]: r["note"] for r in read_folder(spark, str(tmp_path)).collect()}
    assert got == {"1": "two\nlines", "2": "plain", "3": "a, b"}
