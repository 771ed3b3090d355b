"""The corpus pipeline: documents to packed sequences in five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, stages

STAGES = [
    ("quality_classifier", stages.quality),
    ("line_dedup", stages.lines),
    ("jaccard_join", stages.near_copies),
    ("decontamination", stages.benchmark),
    ("packing", stages.packed),
]

#: A fitted classifier and a tokenizer can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What stands between two stages is written to the shared folder and dropped once the
    next has been written; only the last such table stays, as the result reads it."""
    docs, scratch = common.read(spark, sf_dir, "documents"), common.Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        made = scratch.keep(stage(spark, docs, sf_dir))
        if hasattr(docs, "_scratch"):
            scratch.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
