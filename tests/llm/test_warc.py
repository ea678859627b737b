import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc

SCHEMA = "page_id long, url string, html string, seq string, file string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 7}.example/{i}", "<p>é " + "x" * rng.randrange(300) + "\r\n\r\n</p>", "s", "f", "d") for i in range(700)]
    rows += [(9001, None, None, "s", "f", "d"), (None, "u", "", "s", "f", "d"), (5, "http://h5.example/5", "again", "s", "f", "d"), (9002, "u", "#" * 200_000, "s", "f", "d")] + [(9003, "copy", "same", "s", "f", "d")] * 40
    return spark.createDataFrame(rows, SCHEMA)


def brute(a, b):
    """Audit by comparing all records, in (id, digest, uri) order within their file."""

    def keyed(rows):
        out, seen = {}, {}
        for r in sorted(rows, key=lambda r: (r.file, r.seq)):
            key = (r.file, r.id, r.uri)
            seen[key] = seen.get(key, 0) + 1
            out[*key, seen[key]] = r
        return out

    x, y = keyed(a), keyed(b)
    found = []
    for key in x.keys() | y.keys():
        p, q = x.get(key), y.get(key)
        if p is None or q is None or p.digest != q.digest:
            status = "missing" if q is None else "extra" if p is None else "corrupt"
            r = p or q
            found.append((r.file, r.id, r.uri, status, r.start, r.length, p and p.digest, q and q.digest))
    return sorted(found, key=str)


def test_audit_finds_damage(spark, pages):
    found = warc.records(pages)
    a, b = warc.archive(found, 5), warc.archive(warc.damaged(found), 5)
    out = sorted((tuple(r) for r in warc.audit(a, b, 5).collect()), key=str)
    assert out == brute(a.collect(), b.collect()) and {r[3] for r in out} >= {"missing", "corrupt"}
    turned = sorted((tuple(r) for r in warc.audit(b, a, 5).collect()), key=str)
    assert turned == brute(b.collect(), a.collect()) and "extra" in {r[3] for r in turned}


def test_single_changes(spark, pages):
    found = warc.records(pages)
    a = warc.archive(found, 5)
    assert warc.audit(a, warc.archive(found.repartition(7), 5), 5).collect() == []
    changed = warc.archive(found.withColumn("record", F.when(F.col("id") == 77, F.concat("record", F.lit("!"))).otherwise(F.col("record"))), 5)
    assert [(r.id, r.status) for r in warc.audit(a, changed, 5).collect()] == [(77, "corrupt")]
    lost = warc.archive(found.filter("id is null or id != 300"), 5)
    assert [(r.id, r.status) for r in warc.audit(a, lost, 5).collect()] == [(300, "missing")]
    none = warc.archive(found.limit(0), 5)
    assert warc.audit(none, none, 5).collect() == []
    assert len(warc.audit(a, none, 5).collect()) == found.count()


def test_only_mismatching_branches_differ(spark, pages):
    found = warc.records(pages)
    a = warc.archive(found, 2)
    b = warc.archive(found.withColumn("record", F.when(F.col("id") == 77, F.lit("gone")).otherwise(F.col("record"))), 2)
    within, above = warc.depths([a, b], 2)
    trees = [warc.tree(x, within, above) for x in (a, b)]
    assert trees[0].root != trees[1].root and len(trees[0].levels) == within + above
    first = warc._differing(trees[0].levels[0], trees[1].levels[0]).collect()
    assert len({r["at"] for r in first}) == 1


def test_archive_files_round_trip(spark, pages, tmp_path):
    found = warc.records(pages)
    warc.write(found, 3, str(tmp_path / "warc"))
    back = {(r.file, r.seq): r for r in warc.read(spark, str(tmp_path / "warc")).collect()}
    laid = warc.archive(found, 3, ("record",)).collect()
    assert len(back) == len(laid)
    for r in laid:
        got = back[r.file, r.seq]
        assert (got.start, got.length, bytes(got.record).decode()) == (r.start, r.length, r.record)
        assert hashlib.sha256(bytes(got.record)).hexdigest() == r.digest and got.uri == (r.uri or "")
