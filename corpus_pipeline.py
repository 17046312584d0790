"""A corpus pipeline of five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm import stages
from wakeline.plans import drop_materialized, materialize_alone

STAGES = [
    ("quality_rules", stages.quality),
    ("language_id", stages.language),
    ("near_dedup", stages.dedup),
    ("source_mix", stages.mixture),
    ("best_fit_packing", stages.packed),
]

#: Hashes of shingles, vocabularies of a tokenizer and subset sums have no SQL here; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the table between two stages is in the shared folder, and what a stage wrote for itself goes with it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize_alone(spark, partial(stage, spark, docs, sf_dir), name)
        if before is not None:
            drop_materialized(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
