"""The corpus pipeline: quality, near duplicates, decontamination, privacy, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame.  All but the
last return the columns of ``documents``; ``run`` writes what a stage kept as
Parquet in the shared scratch folder and the next one reads it from there, so a
lost executor repeats at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, minhash, packing, pii, quality
from fieldloom.sources.scratch import Scratch


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts to be good; the rest goes."""
    return quality.keep_good(docs, _read(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group (five-word shingles, 0.8)."""
    return minhash.keep_one(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark windows to count as contaminated."""
    return decontaminate.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by format-preserving pseudonyms under the session's key."""
    return pii.replace(docs, pii.session_key(spark)).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Models, signatures and token ids are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table passes through every stage."""
    tmp = Scratch(spark, "pipeline")
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tmp.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
