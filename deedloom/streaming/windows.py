"""Counts in windows that close behind a watermark, with the rows that came too late."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from deedloom.streaming.jobs import _base, _kept, _run


def _end() -> Column:
    return F.unix_micros("window_end")


class Windows:
    """Counts of a stream in tumbling windows by keys.

    `counts` has a folder for the last batches only: all windows that are open at the batch, with the newest time in them. The watermark
    is the newest time less the delay, as for any stream: a window whose end it has reached is closed and leaves, and a row whose window was closed
    before its batch goes whole to a side table. What is kept between batches is bounded by the open windows. A busy window is
    combined before the shuffle. A batch reads only what the one before it left, so running it again writes the same.
    """

    def __init__(self, spark: SparkSession, events: StructType, base: str, keys: Sequence[str], width: str, delay: int):
        self.spark, self.events, self.base, self.keys, self.width, self.delay = spark, events, base, list(keys), width, delay * 1_000_000
        self.schema = self._counted(self._placed(spark.createDataFrame([], events))).schema

    def _placed(self, events: DataFrame) -> DataFrame:
        """Rows with the end of their window; rows without a time have none."""
        return events.where("ts is not null").withColumn("_w", F.window("ts", self.width))

    def _counted(self, placed: DataFrame) -> DataFrame:
        counts = placed.groupBy("_w", *self.keys).agg(F.count(F.lit(1)).alias("events"), F.max(F.unix_micros("ts")).alias("newest"))
        return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *self.keys, "events", "newest")

    def _after(self, batch: int) -> tuple[DataFrame, int | None]:
        """All windows that were open at a batch, and the watermark after it."""
        if batch < 0:
            return self.spark.createDataFrame([], self.schema), None
        counts = self.spark.read.schema(self.schema).parquet(f"{self.base}/counts/batch={batch}")
        newest = counts.agg(F.max("newest")).first()[0]
        return counts, None if newest is None else newest - self.delay

    def add(self, events: DataFrame, batch: int) -> None:
        counts, mark = self._after(batch - 1)
        placed = self._placed(events)
        late = F.lit(False) if mark is None else F.unix_micros("_w.end") <= mark
        placed.where(late).drop("_w").write.mode("overwrite").parquet(f"{self.base}/late/batch={batch}")
        still = counts if mark is None else counts.where(_end() > mark)
        both = still.unionByName(self._counted(placed.where(~late)))
        now = both.groupBy("window_start", "window_end", *self.keys).agg(F.sum("events").alias("events"), F.max("newest").alias("newest"))
        now.write.mode("overwrite").parquet(f"{self.base}/counts/batch={batch}")
        counts, mark = self._after(batch)
        closed = counts.where(F.lit(False) if mark is None else _end() <= mark)
        closed.drop("newest").write.mode("overwrite").parquet(f"{self.base}/closed/batch={batch}")
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/counts/batch={batch - 2}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def stored(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Closed windows, open windows, late rows."""
        result = StructType([f for f in self.schema.fields if f.name != "newest"])
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/counts")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        last = max((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root)), default=-1) if fs.exists(root) else -1
        counts, mark = self._after(last)
        still = counts if mark is None else counts.where(_end() > mark)
        return _kept(self.spark, result, f"{self.base}/closed").drop("batch"), still.drop("newest"), _kept(self.spark, self.events, f"{self.base}/late").drop("batch")


def closing_windows(
    events: DataFrame, keys: Sequence[str] = ("stage",), width: str = "1 day", delay: int = 86400, folder: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs a stream over everything available; returns closed windows, open windows and late rows (STR-03).

    `events` has ts (timestamp) and the keys, null keys are a key; rows without a time are ignored. A row is late when the window it falls in ends
    at or before the newest time of all earlier batches less `delay` seconds. With a `folder` the next run goes on from there.
    """
    base = _base(events.sparkSession, folder)
    windows = Windows(events.sparkSession, events.schema, f"{base}/windows", keys, width, delay)
    _run(events, windows.add, base)
    return windows.stored()


def with_late(closed: DataFrame, still: DataFrame, late: DataFrame, keys: Sequence[str] = ("stage",), width: str = "1 day") -> DataFrame:
    """Every window with its rows in time, its late rows and whether it is closed; both together are all rows."""
    late = late.groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("late"))
    late = late.select(F.col("w.start").alias("window_start"), *keys, F.lit(0).cast("bigint").alias("events"), "late", F.lit(True).alias("closed"))
    on_time: Callable[[DataFrame, bool], DataFrame] = lambda df, closed: df.select(
        "window_start", *keys, "events", F.lit(0).cast("bigint").alias("late"), F.lit(closed).alias("closed")
    )
    every = on_time(closed, True).unionByName(on_time(still, False)).unionByName(late)
    return every.groupBy("window_start", *keys).agg(F.sum("events").alias("events"), F.sum("late").alias("late"), F.max("closed").alias("closed"))
