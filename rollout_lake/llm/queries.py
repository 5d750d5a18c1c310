"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, bpe, chat, collocations, decontaminate, line_dedup, neighbours, quality, secret_scan, sharding, simhash, sketches, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_lines(docs, line_dedup.new_state(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_pairs(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", sketches.text_form(F.col("sketch")).alias("fingerprint"),
        sketches.text_form(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), prefixes AS (
  SELECT conv_id, pos, string_agg(md5(role || chr(0) || text), ',') OVER (
           PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
         max(pos) OVER (PARTITION BY conv_id) AS last
  FROM turns
), whole AS (
  SELECT min(conv_id) AS conv_id, p, min(pos) + 1 AS n_turns, count(*) AS n_copies FROM prefixes WHERE pos = last GROUP BY p
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes x WHERE x.p = w.p AND x.pos < x.last)
)
SELECT t.conv_id, k.n_turns, k.n_copies,
       string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10), '' ORDER BY t.pos) AS text
FROM turns t JOIN kept k ON t.conv_id = k.conv_id
GROUP BY t.conv_id, k.n_turns, k.n_copies
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"
    )


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), k AS (
  SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN k.d IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to, true AS verified
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000
"""


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = neighbours.build(vectors, 20)
    return neighbours.nearest(index, vectors.where("vec_id % 20 = 0"), 20)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_fingerprints, op3_decontaminate, op4_secret_scan, op5_simhash, op6_sharding, op7_bpe,
        op8_quality, op9_chat, op10_warc, op11_neighbours, op12_alignment, op13_collocations,
    )
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op9_chat": OP9_SQL, "op10_warc": OP10_SQL}
