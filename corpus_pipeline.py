"""Corpus pipeline over `documents`, as a chain of written stages.

Each stage works on all rows that its predecessor kept. The first four return documents with their own columns; the
last returns what the mix takes of each document. Nulls, empty texts, repeated rows, empty tables and further columns
are handled as the operators state; labels and benchmark are the tables beside the documents. The stages bound
the session's Arrow batches, as whole texts are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deedloom.llm import decontaminate, quality_classifier, quality_rules, simhash, source_mix
from deedloom.llm.common import bound_batches, table
from deedloom.session import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    bound_batches(spark)
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bound_batches(spark)
    return quality_rules.keep(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more by wide fingerprints."""
    bound_batches(spark)
    return simhash.keep_one_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    bound_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    bound_batches(spark)
    return source_mix.mix(docs)


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("simhash near-dedup", dedup),
    ("benchmark decontamination", decontaminated),
    ("source mix", mixed),
]
# hashed models, compressed sizes and XXH64 are not in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from `documents` on; each result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
