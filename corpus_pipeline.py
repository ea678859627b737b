"""From raw documents to token ids: quality filter, near-duplicate removal, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.bindings.base import Tables
from millrace.llm import mixing, neardup, pieces, quality
from millrace.llm.words import word_count
from millrace.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILAR = 80
WEIGHTS = (1, 2, 3)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose co-trained quality score is at least one half; all of them if nothing can be learnt."""
    return quality.score(docs, Tables(spark, sf_dir).labels).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; documents without an id all stay."""
    return neardup.drop_near_duplicates(docs, SIMILAR).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each row as often as the mix takes it, at most three times."""
    return mixing.repeat(docs, WEIGHTS, word_count("text")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with merge dropout, drawn anew for each copy of a document, and whether they decode to the text."""
    again = Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy("lang", "n_chars")
    numbered = docs.select(*COLUMNS, F.row_number().over(again).alias("copy"))
    return pieces.encode(numbered, verify="lossless", key=["doc_id", "source", "copy"]).drop("copy")


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL can express neither the classifier nor the components; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again."""
    docs = Tables(spark, sf_dir).documents
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
