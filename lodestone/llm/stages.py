"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``documents``. Every stage sees all rows that the one before it kept, whole
texts, nulls and repeated rows included, as the operators define them. Extra columns pass through unchanged; names that
begin with ``_ls_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, jaccard_join, line_dedup, packing, quality_classifier
from .queries import document_site


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier rejects go."""
    model = quality_classifier.train(docs, common.read(spark, sf_dir, "labels"))
    return quality_classifier.kept(docs, model, document_site())


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from all documents but the largest id that holds them; a null text stays null."""
    got = line_dedup.apply(docs, line_dedup.LineIndex.build(docs.select("doc_id", "text")), kept_col="_ls_kept_text", lines_col="_ls_n_lines", dropped_col="_ls_n_dropped")
    text = F.when(F.col("text").isNotNull(), F.col("_ls_kept_text"))
    n_chars = F.when(F.col("_ls_n_dropped") > 0, F.length("_ls_kept_text").cast("long")).otherwise(F.col("n_chars"))
    return got.withColumn("n_chars", n_chars).withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    gone = common.checkpointed(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_ls_gone")))
    if gone.count() * 32 <= common.BROADCAST_LIMIT:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col("_ls_gone"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))
