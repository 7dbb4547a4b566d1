"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it back as the
next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from millrace.llm.common import ship, table, written
from millrace.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches the threshold; the model learns from labelled rows of ``docs``."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.held_out_fold())
    return toxicity.scored(docs.select(COLUMNS), model).where(f"score < {toxicity.THRESHOLD}").select(COLUMNS)


def exact_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    ship(spark)
    return exact_dedup.without_exact_copies(docs).select(COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links form, the document with the least doc_id stays."""
    ship(spark)
    return jaccard_join.one_of_each_group(docs).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    ship(spark)
    return mixing.mixed_documents(docs).select(COLUMNS)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row, with digests of the ids and of the bytes that they decode to."""
    ship(spark)
    return bpe.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("exact_dedup", exact_copies_go),
    ("jaccard_join", one_of_near_copies),
    ("mixing", mixed_sources),
    ("bpe", encoded_documents),
]

#: SQL can't express the toxicity model or BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
