"""The training-data operators bound to the provided tables, and SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.bindings.base import Tables
from millrace.llm import alignment, forest, mixing, neardup, ngramjoin, ordermin, packing, partenum, pieces, pseudolm, quality, sharding, warc
from millrace.llm.words import word_count

MIX_WEIGHTS = (1, 2, 3)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def register(name: str, sql: str | None = None):
    def keep(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


@register("op1_quality")
def quality_scores(t: Tables) -> DataFrame:
    return quality.document_scores(t.documents, t.labels)


@register("op2_near_dedup")
def near_dedup(t: Tables) -> DataFrame:
    return neardup.near_duplicates(t.documents, percent=85).drop("class", "group")


@register("op3_mixing")
def mix_sources(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("text_key", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))  # rows without an id are drawn by their texts
    mixed = mixing.mix(docs, MIX_WEIGHTS, word_count("text"), key=["text_key"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@register("op4_packing")
def packed_rows(t: Tables) -> DataFrame:
    return packing.pack(t.documents)


@register("op5_sharding")
def shards(t: Tables) -> DataFrame:
    sharded = sharding.shard(t.documents, 40)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op6_nearest")
def neighbours(t: Tables) -> DataFrame:
    return forest.nearest(t.embeddings, F.col("vec_id") % 20 == 0, 20)


@register("op7_fingerprints")
def fingerprints(t: Tables) -> DataFrame:
    marked = ordermin.edited_fingerprints(t.documents)
    return marked.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        ordermin.fingerprint(F.col("signature")).alias("fingerprint"), ordermin.fingerprint(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


FIXITY_SQL = """
with r as (
  select page_id as id, url as uri, coalesce(html, '') as body, coalesce(url, '') as u, coalesce(cast(page_id as varchar), '') as k,
    chr(13) || chr(10) as nl from pages),
n as (select *, md5(k || '|' || u) as h from r),
a as (
  select id, uri, k, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-'
    || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl
    || 'WARC-Target-URI: ' || u || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(body) || nl || nl || body as rec from n),
f as (select greatest(32, cast(ceil(sum(strlen(rec) + 4) / 67108864.0) as bigint)) as files from a),
d as (
  select *, substr(md5('damage' || k), 1, 2) as draw, length(rec) // 2 as half,
    cast(cast(('0x' || substr(md5(k), 1, 8)) as bigint) % (select files from f) as integer) as file, sha256(rec) as digest from a),
b as (
  select *, case draw when '00' then substr(rec, 1, half - 1) || case when substr(rec, half, 1) = '#' then '*' else '#' end || substr(rec, half + 1)
    when '01' then substr(rec, 1, half) else rec end as other,
    cast(coalesce(sum(strlen(rec) + 4) over (partition by file order by id nulls first, digest, uri nulls first rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from d)
select file, id, uri, case draw when '02' then 'missing' else 'corrupt' end as status, start, strlen(rec) + 4 as length, digest,
  case when draw <> '02' then sha256(other) end as replica_digest
from b where draw in ('00', '01', '02')
"""


@register("op8_fixity", FIXITY_SQL)
def fixity(t: Tables) -> DataFrame:
    return warc.fixity(t.pages)


@register("op9_pseudo_likelihood")
def pseudo_likelihood(t: Tables) -> DataFrame:
    return pseudolm.score(t.documents)


@register("op10_pieces")
def encode_pieces(t: Tables) -> DataFrame:
    return pieces.encode(t.documents.select("doc_id", "text"), verify="lossless", key=["doc_id"]).drop("text")


@register("op13_spelling_variants")
def spelling_variants(t: Tables) -> DataFrame:
    return partenum.spelling_variants(t.documents)


@register("op12_ngram_join")
def ngram_join(t: Tables) -> DataFrame:
    return ngramjoin.similar_texts(t.documents)


@register("op11_token_alignment")
def token_alignment(t: Tables) -> DataFrame:
    return alignment.with_corpus_counts(alignment.align(t.documents))
