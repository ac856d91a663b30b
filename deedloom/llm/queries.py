"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from deedloom.llm import (
    collocations, decontaminate, fill_middle, license_scan, lm_score, quality_classifier, quality_rules, simhash, source_mix, token_count, top_k,
    url_filter, warc,
)
from deedloom.llm.common import table
from deedloom.llm.oracle import ORACLES  # noqa: F401

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_quality_rules(spark, sf_dir):
    """Not in SQL: compressed sizes."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query
def op10_source_mix(spark, sf_dir):
    """Not in SQL: highest quotients down a tree and hashed order."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


@query
def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op4_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


@query
def op2_warc(spark, sf_dir):
    """Rows come from the archives that it has written."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op3_decontaminate(spark, sf_dir):
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op1_simhash(spark, sf_dir):
    """Not in SQL: XXH64."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_token_count(spark, sf_dir):
    """Not in SQL: dynamic programming over a vocabulary file."""
    return token_count.count(table(spark, sf_dir, "documents"))


@query
def op7_quality_classifier(spark, sf_dir):
    """Not in SQL: hashed n-gram models."""
    return quality_classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_lm_score(spark, sf_dir):
    """Not in SQL: Bloom filter."""
    return lm_score.score(table(spark, sf_dir, "documents"))


@query
def op11_fill_middle(spark, sf_dir):
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@query
def op12_top_k(spark, sf_dir):
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


@query
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
