"""A training corpus from ``documents``: five stages, each on all that the stage before it kept.

Models are trained on the labelled rows of the original tables; scoring, dedup, mixing and packing read whole
texts of all rows of the stage's own input. ``spark.checkpoint.dir`` names the folder for what ``run`` writes
between stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texlake.llm import mixing, near_dedup, packing, quality_classifier, toxicity
from texlake.llm.common import read, remove_folder, shared_folder

#: A document goes if its probability of good quality is below KEEP_QUALITY, or its probability of toxicity is TOXIC or more.
KEEP_QUALITY, TOXIC = 0.3, 0.5


def _scored(spark: SparkSession, docs: DataFrame, model, keeps) -> DataFrame:
    """``docs`` without the rows whose score ``keeps`` refuses; the score lives beside the row, so no name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = docs.select(row.alias("row"), quality_classifier.score_column(model, F.col("text"), spark).alias("score"))
    return scored.where(keeps(F.col("score"))).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return _scored(spark, docs, model, lambda score: score >= KEEP_QUALITY)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return _scored(spark, docs, model, lambda score: score < TOXIC)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", dedup), ("mixing", mixture), ("packing", packed)]

#: Trained classifiers have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again.

    A stage's folder goes once the next stage is written; that of the last but one stays, as the result reads it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove_folder(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
