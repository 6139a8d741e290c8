"""The corpus pipeline: language ID, near copies, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grafloom.llm import _store, stages

STAGES = [
    ("language", stages.identify_language),
    ("near_copies", stages.drop_near_copies),
    ("secrets", stages.mask_secrets),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Learned models and random rounding are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _store.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
