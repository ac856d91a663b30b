"""Import of downloaded files with an audit of what was skipped and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def list_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files directly in a folder with content and time (SRC-01)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return df.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("modificationTime").alias("modified_at")
    )


def is_pdf(c: Column) -> Column:
    return F.endswith(F.lower(c), F.lit(".pdf"))


def import_audit(files: DataFrame, known: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Outcome of every scanned file: imported, or skipped as old, existing or repeated (SRC-02, SRC-03, JN-12, WIN-10).

    `files` has case_id, name, content, modified_at; `known` has case_id and content_hash. A file as old
    as the cutoff is skipped. Contents are hashed where they are read; only hashes are shuffled.
    """
    old = F.lit(False) if cutoff is None else F.col("modified_at") <= cutoff
    scanned = files.where(is_pdf(F.col("name"))).select("case_id", "name", "modified_at", old.alias("_old"), F.sha2("content", 256).alias("content_hash"))
    known = known.select("case_id", "content_hash").distinct().withColumn("_known", F.lit(True))
    marked = scanned.join(known, ["case_id", "content_hash"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    # the first name among fresh files of a content is the one imported
    fresh = marked.where("not _old and not _known").groupBy("case_id", "content_hash").agg(F.min("name").alias("_first"))
    return marked.join(fresh, ["case_id", "content_hash"], "left").select(
        "case_id", "name", "modified_at", "content_hash",
        F.when(F.col("_old"), "skipped_old").when(F.col("_known"), "skipped_existing")
        .when(F.col("name") != F.col("_first"), "skipped_batch").otherwise("imported").alias("outcome"),
    )


def import_counts(audit: DataFrame) -> DataFrame:
    """Files per outcome (AGG-15)."""
    return audit.groupBy("case_id", "outcome").agg(F.count(F.lit(1)).alias("files"))
