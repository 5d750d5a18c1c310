"""From raw documents to token ids: quality, repeated lines, near-duplicates, benchmark overlaps, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. A stage works on all rows that
the one before it kept; ``run`` writes every stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_lake.llm import bpe, decontaminate, line_dedup, near_stage, quality
from rollout_lake.llm.common import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts as good; it learns from the rows of ``labels`` not held out.

    Each row is judged by its text alone, so repeated rows and ties go the same way; null and empty texts have the score of
    a text without words. Rows without an id, a text or a label are not learned from. Empty table: empty result.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that three of them hold (kept in the one of largest id).

    ``n_chars``, where there is one, follows the text. Null text: becomes empty. Rows without an id are one document, below all
    ids; rows that repeat an id are one document, each of which loses its lines. Empty table: empty result.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = line_dedup.drop_lines(docs.withColumnsRenamed(own), line_dedup.new_state(docs))
    kept = kept.drop("n_lines", "n_dropped").withColumnsRenamed({hidden: c for c, hidden in own.items()}).select(*docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates.

    Texts without words are copies of each other. Rows that repeat an id stay or go together; rows without an id
    stay. Empty table: empty result.
    """
    return near_stage.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no passage with ``benchmark``.

    Rows that repeat an id stay or go together; rows without an id are judged each by its text. Null text: stays. Empty
    tables: all rows stay.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token ids and the digests of ids and decoded text; null and empty texts have no tokens."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", encoding_stage),
]

ORACLE_SQL = None
"""A trained classifier and a tokenizer are beyond SQL; the tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        before, done = done, written(stage(spark, docs if done is None else done, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
    return done
