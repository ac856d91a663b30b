"""Counters and labels of cases, documents, jobs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deedloom import fixed
from deedloom.functions import text as T
from deedloom.operators.positions import first_per_key


def case_stats(cases: DataFrame, documents: DataFrame, records: DataFrame, reports: DataFrame) -> DataFrame:
    """Counts per case (AGG-04)."""
    n = F.count(F.lit(1))
    d = documents.groupBy("case_id").agg(
        n.alias("documents"), F.count_if(F.col("parse_status") == "ocr_done").alias("ocr_ready"),
        F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"),
    )
    r = records.groupBy("case_id").agg(n.alias("servitutter"))
    p = reports.groupBy("case_id").agg(n.alias("reports"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = cases.join(d, "case_id", "left").join(r, "case_id", "left").join(p, "case_id", "left")
    return joined.select(
        "case_id", *[zero(c) for c in ("documents", "ocr_ready", "pages", "chunks", "servitutter", "reports")],
        F.coalesce("status", F.lit("ukendt")).alias("case_status"),
    )


def workspace_totals(stats: DataFrame) -> DataFrame:
    """Totals over all cases (AGG-05)."""
    return stats.agg(
        F.count(F.lit(1)).alias("cases"), F.sum("documents").alias("documents"), F.sum("servitutter").alias("servitutter"),
        F.sum("reports").alias("reports"),
    )


def next_step() -> Column:
    """What a case needs next (FLT-12)."""
    return (
        F.when(F.col("documents") == 0, "upload").when(F.col("chunks") == 0, "ocr").when(F.col("servitutter") == 0, "filter")
        .when(F.col("reports") == 0, "report").otherwise("edit")
    )


def status_labels(documents: DataFrame) -> DataFrame:
    """Display labels of the parse status (FLT-11)."""
    s = F.col("parse_status")
    label, state, detail = s, F.lit(fixed.BATCH_STATE_QUEUED[0]), F.lit(fixed.BATCH_STATE_QUEUED[1])
    for k, v in fixed.PARSE_STATUS_LABELS.items():
        label = F.when(s == k, v).otherwise(label)
    for k, (a, b) in fixed.BATCH_STATES.items():
        state, detail = F.when(s == k, a).otherwise(state), F.when(s == k, b).otherwise(detail)
    return documents.withColumns({"status_label": label, "batch_state": state, "batch_detail": detail})


def pending_documents(documents: DataFrame) -> DataFrame:
    """Documents still to read, with the next one of each case flagged by order (FLT-10)."""
    return documents.where(F.col("parse_status") != "ocr_done")


def next_pending(documents: DataFrame) -> DataFrame:
    return first_per_key(pending_documents(documents), ["case_id"], ["pos"])


def reading_estimate(documents: DataFrame, seconds: int = fixed.SECONDS_PER_PAGE) -> DataFrame:
    """Seconds left per case and their label (AGG-25, TXT-39)."""
    total = pending_documents(documents).groupBy("case_id").agg((F.sum("page_count") * seconds).alias("seconds"))
    return total.withColumn("label", T.duration_label("seconds"))


def reading_evaluation(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mean quality of ok pages, total characters and share of keyword chunks per case (AGG-14)."""
    ok = F.col("confidence") >= fixed.LOW_PAGE_CUT
    p = pages.groupBy("case_id").agg(
        F.round(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)), 6).alias("mean_confidence"),
        F.sum(F.length("text")).alias("total_chars"),
    )
    c = chunks.groupBy("case_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(T.has_keywords("text")).alias("keyword_chunks"))
    return p.join(c, "case_id", "left").select("case_id", "mean_confidence", "total_chars", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("chunks", "keyword_chunks")])


def canonical_source(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """The stored list of a case, else its confirmed saved records (FLT-13, FLT-14)."""
    rest = saved.where("attest_confirmed").join(stored.select("case_id").distinct(), "case_id", "left_anti")
    return stored.withColumn("origin", F.lit("stored")).unionByName(rest.withColumn("origin", F.lit("saved")), allowMissingColumns=True)


def tracked_documents(chunks: DataFrame, documents: DataFrame, has_canonical: DataFrame) -> DataFrame:
    """Documents an extraction follows: those with chunks, without register extracts where a list is stored (SET-06)."""
    docs = chunks.select("case_id", "document_id").distinct()
    done = documents.where(F.col("document_type") == fixed.REGISTER_TYPE).join(has_canonical.select("case_id").distinct(), "case_id", "left_semi")
    return docs.join(done.select("case_id", "document_id"), ["case_id", "document_id"], "left_anti")


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Newest active job of each case by file order (SRC-09)."""
    return first_per_key(jobs.where(F.col("status").isin(*fixed.JOB_ACTIVE)), ["case_id"], [F.desc("job_id")])


def unique_links(links: DataFrame) -> DataFrame:
    """First link per address, empty addresses dropped (SET-07)."""
    return first_per_key(links.where(F.coalesce("href", F.lit("")) != ""), ["page_id", "href"], ["index"])


def progress_share(events: DataFrame, totals: DataFrame) -> DataFrame:
    """Finished documents of all tracked ones per case (AGG-26)."""
    done = events.where(F.col("stage").isin(*fixed.PROGRESS_FINISHED)).groupBy("case_id").agg(F.count_distinct("doc_id").alias("finished"))
    return totals.join(done, "case_id", "left").withColumn("finished", F.coalesce("finished", F.lit(0)))
