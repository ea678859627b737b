"""Fixity audit of replicated WARC archives with hash trees.

An archive is a number of files, a file an order of records.  The leaves of its tree are the records' hashes; a node
hashes an ordered range of ``FAN`` children together with the byte range they cover, level by level up to a root per
file, and on over ranges of files to one root of the archive.  Two replicas are compared from the root down: only
children of mismatching nodes are read, and a mismatching leaf range is resolved record by record, so a lost record,
which moves all that follows it in its file, is told from the records it moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import settle, written

FAN = 16
#: Bytes of records in a file, about, and files at least.
FILE_BYTES, LEAST_FILES = 64 << 20, 32
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _number(text: Column) -> Column:
    """The first 32 bits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def record(uri: Column, body: Column, key: Column, date: str = DATE) -> Column:
    """A WARC 1.1 resource record without the two line ends after its block."""
    name = F.md5(F.concat_ws("|", key, F.coalesce(uri, F.lit(""))))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    size = F.octet_length(body).cast("string")
    lines = [
        F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(uri, F.lit(""))), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), size), F.lit(""), body,
    ]
    return F.concat_ws(CRLF, *lines)


def records(df: DataFrame, id: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """(id, uri, record) of a table of pages.  Null bodies and addresses are empty; a null id is written as nothing."""
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    text = record(F.col(uri).cast("string"), F.coalesce(F.col(body).cast("string"), F.lit("")), key)
    return df.select(F.col(id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), text.alias("record"))


def file_count(found: DataFrame) -> int:
    total = found.agg(F.sum(F.octet_length("record") + 4)).first()[0] or 0
    return max(LEAST_FILES, -(-total // FILE_BYTES))


def archive(found: DataFrame, files: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(file, seq, start, length, id, uri, digest, *carry): the records laid out in files, by id and hash.

    A record's file follows from its id; ``start`` and ``length`` are its bytes, its closing line ends included.
    """
    digest = F.sha2(F.col("record").cast("binary"), 256)
    laid = found.select((_number(F.coalesce(F.col("id").cast("string"), F.lit(""))) % files).cast("int").alias("file"), "id", "uri", digest.alias("digest"), (F.octet_length("record") + 4).cast("long").alias("length"), *carry)
    order = Window.partitionBy("file").orderBy("id", "digest", "uri")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    return laid.select("file", "seq", "start", "length", "id", "uri", "digest", *carry)


@dataclass
class Tree:
    """Leaves, and the nodes (at, part, start, stop, hash) of each level above; ``at`` is a file or a range of files."""

    leaves: DataFrame
    levels: list[DataFrame]

    @property
    def root(self) -> str | None:
        top = self.levels[-1].select("hash").collect()  # one node
        return top[0]["hash"] if top else None


def _depth(n: int) -> int:
    """Levels of ranges of FAN that leave one of n."""
    return 0 if n <= 1 else 1 + _depth(-(-n // FAN))


def depths(leaves: list[DataFrame], files: int) -> tuple[int, int]:
    """Levels above the records of a file, and above the files; the same for all replicas."""
    most = max(x.agg(F.max("seq")).first()[0] or 0 for x in leaves)
    return max(1, _depth(most + 1)), _depth(files)


def tree(leaves: DataFrame, within: int, above: int) -> Tree:
    """The hash tree of (file, seq, start, length, id, uri, digest).  Every node gathers at most FAN children."""
    own = F.sha2(F.concat_ws(":", "start", "length", "digest"), 256)
    nodes = leaves.select(F.col("file").cast("long").alias("at"), F.col("seq").alias("part"), "start", (F.col("start") + F.col("length")).alias("stop"), own.alias("hash"))
    levels = []
    for level in range(within + above):
        inside = level < within
        parent = [F.col("at") if inside else F.floor(F.col("at") / FAN).alias("at"), F.floor(F.col("part") / FAN).alias("part") if inside else F.lit(0).cast("long").alias("part")]
        # above the files byte ranges start anew in each, and the covered range is told by the count of bytes
        grouped = nodes.select(*parent, F.struct(F.col("at").alias("a"), F.col("part").alias("p"), "hash").alias("child"), "start", "stop").groupBy("at", "part")
        nodes = grouped.agg(F.array_sort(F.collect_list("child")).alias("children"), F.min("start").alias("start"), F.max("stop").alias("stop"))
        joined = F.concat_ws(":", F.col("start"), F.col("stop"), F.transform("children", lambda c: c["hash"]))
        nodes = settle(nodes.select("at", "part", "start", "stop", F.sha2(joined, 256).alias("hash")))
        levels.append(nodes)
    return Tree(leaves, levels)


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(at, part) of nodes that are not equal in both."""
    b = b.select(F.col("at").alias("at_"), F.col("part").alias("part_"), F.col("hash").alias("hash_"))
    both = a.select("at", "part", "hash").join(b, (F.col("at") == F.col("at_")) & (F.col("part") == F.col("part_")), "full")
    return both.filter(~F.col("hash").eqNullSafe(F.col("hash_"))).select(F.coalesce("at", "at_").alias("at"), F.coalesce("part", "part_").alias("part"))


def audit(a: DataFrame, b: DataFrame, files: int) -> DataFrame:
    """Records in which replica ``b`` differs from ``a``, both (file, seq, start, length, id, uri, digest).

    Returns (file, id, uri, status, start, length, digest, replica_digest): ``corrupt`` where a record's bytes differ,
    ``missing`` where b has lost it, ``extra`` where a has no such record (bytes of b are then given).  Records that
    only moved are not reported.  Records are matched by id, address and, for repeated ones, their order in the file.
    Equal replicas give an empty result after reading two root hashes; so do two empty ones.
    """
    within, above = depths([a, b], files)
    trees = [tree(x, within, above) for x in (a, b)]
    none = "file int, id long, uri string, status string, start long, length long, digest string, replica_digest string"
    if trees[0].root == trees[1].root:
        return a.sparkSession.createDataFrame([], none)
    bad = _differing(trees[0].levels[-1], trees[1].levels[-1])
    for level in range(within + above - 2, -1, -1):
        # children of the mismatching nodes, from the level below
        inside = level + 1 < within
        up_at, up_part = (F.col("at"), F.floor(F.col("part") / FAN)) if inside else (F.floor(F.col("at") / FAN), F.lit(0))
        bad = settle(bad).toDF("bad_at", "bad_part")
        below = [t.levels[level].join(bad, (up_at == F.col("bad_at")) & (up_part == F.col("bad_part")), "left_semi") for t in trees]
        bad = _differing(*below)
    bad = settle(bad).toDF("bad_at", "bad_part")
    sides = []
    for x in (a, b):
        hit = x.join(bad, (F.col("file") == F.col("bad_at")) & (F.floor(F.col("seq") / FAN) == F.col("bad_part")), "left_semi")
        sides.append(hit.select("file", "id", "uri", "seq", "start", "length", "digest"))
    return _records(sides[0], sides[1])


def _records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Resolve mismatching ranges record by record.

    A moved record can lie in a mismatching range of one side and, by its count, in a range of the other that matches;
    such ranges hold the same records, so a record absent on one side only counts when its bytes are absent there.
    """
    again = Window.partitionBy("file", "id", "uri").orderBy("seq")
    sides = [x.withColumn("copy", F.row_number().over(again)) for x in (a, b)]
    right = sides[1].select(*[F.col(c).alias(f"{c}_") for c in sides[1].columns])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("file", "id", "uri", "copy")]
    cond = same[0]
    for s in same[1:]:
        cond &= s
    both = sides[0].join(right, cond, "full").filter(~F.col("digest").eqNullSafe(F.col("digest_")))
    status = F.when(F.col("seq_").isNull(), "missing").when(F.col("seq").isNull(), "extra").otherwise("corrupt")
    pick = [F.coalesce(c, f"{c}_").alias(c) for c in ("file", "id", "uri", "start", "length")]
    return both.select(*pick[:3], status.alias("status"), *pick[3:], "digest", F.col("digest_").alias("replica_digest"))


def write(found: DataFrame, files: int, path: str) -> None:
    """Write records as WARC files: one folder per file number, records in order."""
    laid = archive(found, files, ("record",)).repartition("file").sortWithinPartitions("file", "seq")
    laid.select("file", F.col("record").alias("value")).write.partitionBy("file").option("lineSep", CRLF * 2).text(path)


def parse(raw: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(start, length, address, record without its closing line ends) of the records of a WARC file."""
    at = 0
    while at < len(raw):
        block = raw.index(b"\r\n\r\n", at) + 4
        head = dict(line.split(b": ", 1) for line in raw[at:block].split(b"\r\n")[1:] if line)
        stop = block + int(head[b"Content-Length"])
        yield at, stop + 4 - at, head[b"WARC-Target-URI"].decode(), raw[at:stop]
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, start, length, uri, record) of a folder written by ``write``; a task reads a file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                number = int(path.as_py().split("file=")[1].split("/")[0])
                rows = [(number, seq, *r) for seq, r in enumerate(parse(content.as_py()))]
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "seq", "start", "length", "uri", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(run, "file int, seq long, start long, length long, uri string, record binary")


def damaged(found: DataFrame) -> DataFrame:
    """A replica for tests of the audit: by a hash of its id a record in 256 each is altered, cut in half, or lost."""
    draw = F.substring(F.md5(F.concat(F.lit("damage"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 2)
    n, half = F.char_length("record"), F.floor(F.char_length("record") / 2).cast("int")
    at = F.substring(F.col("record"), half, F.lit(1))
    altered = F.concat(F.substring(F.col("record"), F.lit(1), half - 1), F.when(at == "#", "*").otherwise("#"), F.substring(F.col("record"), half + 1, n))
    changed = F.when(draw == "00", altered).when(draw == "01", F.substring(F.col("record"), F.lit(1), half)).otherwise(F.col("record"))
    return found.filter(draw != "02").withColumn("record", changed)


def fixity(df: DataFrame) -> DataFrame:
    """Audit of a table of pages against its ``damaged`` replica."""
    found = records(df)
    files = file_count(found)
    return audit(written(archive(found, files)), written(archive(damaged(found), files)), files)
