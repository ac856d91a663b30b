"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# bytes outside digits, letters and the bytes of non-ASCII characters become blanks
ITEM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
# ASCII blanks: bytes.split() without an argument cuts at exactly these
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *wanted: tuple[str, str]) -> DataFrame:
    """The named columns cast to the given types; other columns, whatever their names, are left out."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in wanted])


def blank_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII blanks; none for a null."""
    return text.encode().split() if text else []


def lower_blank_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.encode().translate(LOWER_BYTES).split() if text else []


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters a-z and non-ASCII characters."""
    return text.encode().translate(ITEM_BYTES).split() if text else []


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list]], schema: str) -> DataFrame:
    """mapInArrow over small slices of a batch, so that a task holds few decoded texts at a time.

    `make()` runs once per task and gives a function from a slice {column: list} to the output columns in
    the order of `schema`, each as long as the slice needs.
    """
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(fields)
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = step({c: part.column(c).to_pylist() for c in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out)

    return df.mapInArrow(run, fields)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows in this session: whole texts are long, and a worker holds a batch several times."""
    before = int(spark.conf.get(BATCH))
    spark.conf.set(BATCH, min(rows, before) if before > 0 else rows)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The same for the jobs run inside; the session's value comes back."""
    before = spark.conf.get(BATCH)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def small_enough(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Marks a written table for broadcast if its rows surely fit `limit`; otherwise the planner shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
