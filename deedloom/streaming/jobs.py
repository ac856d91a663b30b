"""Structured Streaming forms: job states, progress, incremental import, reuse by fingerprint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from deedloom import fixed
from deedloom.session import shared_folder
from deedloom.sources.imports import BINARY_SCHEMA
from deedloom.streaming.contents import Contents


def _base(spark: SparkSession, folder: str | None) -> str:
    return folder or f"{shared_folder(spark).rstrip('/')}/deedloom-stream-{uuid.uuid4().hex}"


def gathered(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """Runs a stream over everything available and returns what `partial` makes of each batch.

    What is kept lives in a table, one folder per batch, not in a state store: it needs no watermark, so no late
    row is lost, and no memory that grows with the keys. Rerunning a batch overwrites its own folder. With a
    `folder` the next run goes on where the last one ended.
    """
    spark = stream.sparkSession
    base = _base(spark, folder)
    schema = partial(spark.createDataFrame([], stream.schema)).schema

    def step(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    _run(stream, step, base)
    return _kept(spark, schema, f"{base}/out")


def stored_batches(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over everything available, stores each batch once and returns all that is stored, with its batch."""
    spark = stream.sparkSession
    base = _base(spark, folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    _run(stream, step, base)
    return _kept(spark, stream.schema, f"{base}/out")


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], base: str) -> None:
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _kept(spark: SparkSession, schema: StructType, out: str) -> DataFrame:
    """All batches so far; the folder of an empty batch makes sure that there is one."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).option("basePath", out).parquet(out)


def _job_part(events: DataFrame) -> DataFrame:
    terminal = F.col("status").isin(*fixed.JOB_TERMINAL)
    seq = F.col("seq") if "seq" in events.columns else F.lit(0)
    return events.groupBy("job_id").agg(
        F.min(F.when(terminal, F.struct("ts", seq.alias("seq"), "status"))).alias("ended"),
        F.max(F.struct("ts", (-seq).alias("back"), "status")).alias("newest"),
        F.min(F.when(F.col("status") == fixed.JOB_WAITING, F.col("ts"))).alias("waiting_since"),
        F.max(F.when(~terminal, F.col("ts"))).alias("last_active"),
        F.min("ts").alias("started_at"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """State of each job from its status events, stored or streamed (STR-02).

    `events` has job_id, ts and status. The first terminal status ends a job; until then the newest
    status counts. Of events at one time the one with the smallest `seq` counts, where there is that column. All are plain aggregates, so events of a busy job are combined before the shuffle
    and may arrive late or in any order.
    """
    if not events.isStreaming:
        return _job_part(events)
    return gathered(events, _job_part).groupBy("job_id").agg(
        F.min("ended").alias("ended"), F.max("newest").alias("newest"), F.min("waiting_since").alias("waiting_since"),
        F.max("last_active").alias("last_active"), F.min("started_at").alias("started_at"),
    )


def job_status(states: DataFrame, now: Column, timeout: int = fixed.JOB_HEARTBEAT_TIMEOUT, ready: int | None = fixed.JOB_READY_TIMEOUT) -> DataFrame:
    """Current status: ended, failed for lack of a heartbeat or of the user's sign while it waits, or the newest. `ready` None sets no limit to waiting."""
    waiting = (F.col("newest.status") == fixed.JOB_WAITING) & (F.timestamp_diff("SECOND", F.col("waiting_since"), now) > F.lit(ready))
    silent = (F.timestamp_diff("SECOND", F.col("newest.ts"), now) > timeout) | F.coalesce(waiting, F.lit(False))
    status = F.when(F.col("ended").isNotNull(), F.col("ended.status")).when(silent, F.lit("failed")).otherwise(F.col("newest.status"))
    return states.select(
        "job_id", status.alias("status"), F.coalesce("ended.ts", "newest.ts").alias("last_heartbeat_at"), "started_at",
        F.when(F.col("ended").isNull() & silent, F.lit("Timeout")).alias("error_message"),
    )


def _progress_part(events: DataFrame) -> DataFrame:
    return events.groupBy("doc_id").agg(F.max(F.struct("ts", "stage", "progress")).alias("m"), F.count(F.lit(1)).alias("events"))


def progress_latest(events: DataFrame) -> DataFrame:
    """Newest stage of each document and how many events it sent, stored or streamed (STR-03)."""
    parts = gathered(events, _progress_part) if events.isStreaming else _progress_part(events)
    return parts.groupBy("doc_id").agg(F.max("m").alias("m"), F.sum("events").alias("events")).select("doc_id", "m.ts", "m.stage", "m.progress", "events")


def progress_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events per stage in tumbling windows, late ones included (STR-03)."""

    def part(e: DataFrame) -> DataFrame:
        counts = e.groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count(F.lit(1)).alias("events"))
        return counts.select(F.col("w.start").alias("window_start"), "stage", "events")

    parts = gathered(events, part) if events.isStreaming else part(events)
    return parts.groupBy("window_start", "stage").agg(F.sum("events").alias("events"))


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files as they arrive in a folder, however old their time stamp is."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.option("maxFileAge", "36500d").load(folder)


def new_contents(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Files whose content was never stored before, of all batches so far (STR-01).

    Each batch is compared with every stored hash, however old; with a `folder` also with those of earlier runs. Of equal
    contents in a batch the earliest file counts, ties by path; rows without content are ignored.
    """
    base = _base(files.sparkSession, folder)
    index = Contents(files.sparkSession, files.schema, f"{base}/contents")
    _run(files, index.add, base)
    return index.stored()


def changed_step(
    spark: SparkSession, schema: StructType, signature: Callable[[DataFrame], DataFrame], process: Callable[[DataFrame], DataFrame], base: str
) -> tuple[Callable[[DataFrame, int], None], Callable[[], DataFrame]]:
    """The work of one batch for `process_changed`, and a reader of all that is stored so far.

    A batch stores its fingerprints and its results in folders of its own and compares only with batches before it, so
    running it again, whole or after a failure half-way, stores the same rows once.
    """
    keys = ["case_id", "document_id"]
    empty = spark.createDataFrame([], schema)
    kept = signature(empty).select(*keys, "source_signature").schema

    def step(batch: DataFrame, batch_id: int) -> None:
        earlier = _kept(spark, kept, f"{base}/state").where(F.col("batch") < batch_id)
        last = earlier.groupBy(*keys).agg(F.max_by("source_signature", "batch").alias("_last"))
        found = signature(batch).select(*keys, "source_signature").join(last, keys, "left")
        fresh = found.where(F.col("_last").isNull() | (F.col("_last") != F.col("source_signature"))).drop("_last")
        mine = f"{base}/state/batch={batch_id}"
        fresh.select(*kept.names).write.mode("overwrite").parquet(mine)
        stored = spark.read.schema(kept).parquet(mine).select(*keys)
        process(batch.join(stored, keys, "left_semi")).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    return step, lambda: _kept(spark, process(empty).schema, f"{base}/out")


def process_changed(
    stream: DataFrame, signature: Callable[[DataFrame], DataFrame], process: Callable[[DataFrame], DataFrame], folder: str | None = None
) -> DataFrame:
    """Batch by batch: fingerprint the documents, drop those whose newest stored fingerprint is the same, process the rest (STR-04).

    A batch holds whole documents. Returns what `process` gave, with the number of its batch; with a `folder` the next
    run goes on where the last one ended.
    """
    base = _base(stream.sparkSession, folder)
    step, stored = changed_step(stream.sparkSession, stream.schema, signature, process, base)
    _run(stream, step, base)
    return stored()
