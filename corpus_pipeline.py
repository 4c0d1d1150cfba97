"""The corpus pipeline: raw documents to packed training sequences, five stages of the training-data operators.

Each stage takes the documents that its predecessor kept, written as Parquet and read again; all but the last
return rows with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import minhash, mixing, packing, quality_rules, suffix_dedup
from chronolith.llm.common import written

#: Near copies in the corpus: word shingles with a Jaccard similarity of 0.80 or more (0.85 is op10's contract only).
NEAR_PERCENT = 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.without_duplicates(docs, NEAR_PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once."""
    return suffix_dedup.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats), ("mixing", mix), ("packing", pack)]

#: Hash buckets, byte-level matches and token ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
