"""A corpus pipeline of five stages; each takes what the one before kept.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame, with the columns of documents in all but
the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm.common import materialise
from edgeloom.llm.packing import pack
from edgeloom.llm.quality_rules import quality_filter
from edgeloom.llm.queries import tokenizer_path
from edgeloom.llm.secret_scan import redacted
from edgeloom.llm.simhash import near_dedup
from edgeloom.llm.source_mix import mixed_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redacted(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return pack(docs, tokenizer_path(), end_id=0, with_ids=True)


STAGES = [("quality rules", quality_stage), ("simhash near-dedup", near_dedup_stage), ("secret scans", secrets_stage), ("source mix", mix_stage), ("packing", packing_stage)]

#: Fingerprints, hashes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
