"""A cleaning pipeline over ``documents``: each stage works on what its predecessor kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, exact_dedup, ngram_join, pieces, quality
from codeloom.settings import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model rejects go."""
    return quality.accepted(docs, spark.read.parquet(os.path.join(sf_dir, "labels.parquet")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one stays."""
    return exact_dedup.keep_first_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets connect, the one with the smallest id stays."""
    return ngram_join.keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words stand in benchmark windows go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text that is left."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]

# Learned scores and sampled segmentations have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{number}")
    return docs
