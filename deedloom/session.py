"""Session helpers: a local session for tests, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | None = None) -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings the session."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("deedloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the one the cluster names; a scratch folder only in local tests."""
    if _SCOPE.get():
        return _SCOPE.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Unlike a cache it survives lost executors; unlike recomputation it costs one pass, and later
    readers prune its columns and know its size. Texts are most of it, so it is packed with zstd.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/deedloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for the jobs run inside, where a row is long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[str]:
    """Everything written inside goes to a folder of its own, which is deleted at the end.

    Results must be stored elsewhere before the scope ends, as plans read what was written.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/deedloom-scope-{uuid.uuid4().hex}"
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
