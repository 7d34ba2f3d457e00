"""A training corpus from raw documents, in five stages.

Each stage takes what its predecessor kept, as a DataFrame read from Parquet, and
returns the documents that stay, with their columns unchanged; the last
stage returns the digests of the encoded and decoded texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from cairn.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that are not resampled go."""
    return quality.Resampler(docs, table(spark, sf_dir, "labels")).keep_rows(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the largest doc_id stays."""
    return exact_dedup.keep_rows(docs, exact_dedup.exact_dedup(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each component the smallest doc_id stays."""
    stays = ngram_join.near_duplicates(docs).where("id <=> component_id").select("id").distinct()
    return docs.join(stays, docs.doc_id.eqNullSafe(stays.id), "left_semi")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every text is encoded and decoded."""
    path = public_tokenizers.path(bpe.WORD_BPE)
    return bpe.round_trip(docs, path).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]

#: Resampling, graph components and byte pair merges have no SQL form; tests/llm
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
