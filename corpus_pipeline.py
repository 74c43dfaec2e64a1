"""Corpus pipeline: quality rules, quality classifier, near-duplicates, benchmark passages, token digests.

Each stage takes what the one before it kept and returns the columns of documents; the last returns a row of token
digests for each document. Rejected documents go; of near-duplicates the one with the smallest doc_id stays; documents
that hold a benchmark passage go. Nulls, empty texts and empty tables follow the operators' own rules: documents
without words fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import bpe, decontaminate, near_dup, quality_density, quality_rules
from colloquy.llm.common import read, written
from colloquy.llm.queries import BYTE_BPE


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_quality(docs, read(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_density.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), mode="documents")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
