"""A corpus pipeline: each stage works on all that the one before kept, the last one packs training sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from depthlog.llm import classifier, line_dedup, packing, simhash, suffix_dedup
from depthlog.operators.staging import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is at least 0.3, the threshold of `predicted`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Only texts with a label that the fit uses are profiled for it; these ids are bounded by classifier.MAX_ROWS.
    wanted = F.broadcast(classifier.labelled(labels).select("doc_id"))
    stats = classifier.document_stats(docs.join(wanted, "doc_id", "left_semi"), "text", "doc_id")
    model = classifier.fit(stats, labels)
    return docs.filter(classifier.text_score(model)(F.col("text")) >= 0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occurred earlier."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier."""
    return suffix_dedup.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
          ("suffix_array_dedup", substrings), ("best_fit_packing", packed)]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again, so that none repeats the work before it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
