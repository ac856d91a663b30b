"""Known contents of a stream of files, kept in runs that are merged as they grow in number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

# runs of this many batches are merged into one
FANOUT = 8
# contents per Bloom block of 32768 bits: sixteen bits each and four tests let about 0.3 % of new contents through
BLOCK_CONTENTS = 2048
# blocks whose contents share a folder
PART_BLOCKS = 64
BLOOM = StructType([StructField("block", LongType()), StructField("blocks", LongType()), StructField("bits", BinaryType())])


def cover(batch: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """The runs that together hold every batch before `batch`: at most fanout - 1 of each size."""
    out, at, size = [], 0, 1
    while size * fanout <= batch:
        size *= fanout
    while at < batch:
        while at + size > batch:
            size //= fanout
        out.append((at, at + size))
        at += size
    return out


def merges(batch: int, fanout: int = FANOUT) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Runs that a batch completes, smallest first, each with the runs it is made of."""
    end, size, out = batch + 1, fanout, []
    while end % size == 0:
        part = size // fanout
        out.append(((end - size, end), [(s, s + part) for s in range(end - size, end, part)]))
        size *= fanout
    return out


def _number(i: int) -> Column:
    return F.conv(F.substring("content_hash", 1 + 8 * i, 8), 16, 10).cast("bigint")


def _bits() -> list[Column]:
    """Four places in a block, from other digits than the block's number."""
    return [(_number(i) % 32768).cast("bigint") for i in (1, 2, 3, 4)]


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.getbit(byte, (place % 8).cast("int")) == 1


class Contents:
    """Files with new contents by batch, in runs `b<from>to<to>` under a folder.

    A run holds the first file of each content that its batches brought, in parts of a hash range's remainder and sorted by hash, and a
    Bloom filter as blocks of bits. A batch asks the filters of the covering runs and reads only the parts that may hold one of its
    hashes, so runs are hardly read for new contents. Every `fanout` runs become one: a file is rewritten once per level, and the
    number of runs and folders grows with the logarithm of the number of batches.

    Which runs a batch reads follows from its number alone. Runs that were merged are deleted by the next batch, when the merging one
    is committed, so a batch that is run again finds what it found before and overwrites what it wrote.
    """

    def __init__(self, spark: SparkSession, files: StructType, base: str, fanout: int = FANOUT):
        self.spark, self.base, self.fanout = spark, base, fanout
        # runs whose rows the last batch read
        self.read_runs: list[tuple[int, int]] = []
        names = [f for f in files.fieldNames() if f not in ("content", "content_hash")]
        self.order = [n for n in ("modificationTime", "path") if n in names]
        self.order += [n for n in names if n not in self.order]
        self.schema = self._unique(spark.createDataFrame([], files)).schema

    def _unique(self, files: DataFrame) -> DataFrame:
        """One file per content: the earliest, ties by path. Contents are hashed where they are read."""
        hashed = files.withColumn("content_hash", F.sha2("content", 256)).where("content_hash is not null")
        first = hashed.groupBy("content_hash").agg(F.min(F.struct(*self.order)).alias("_f"))
        return first.select(*[F.col("_f")[n].alias(n) for n in self.order], "content_hash")

    def _path(self, kind: str, run: tuple[int, int]) -> str:
        return f"{self.base}/{kind}/run=b{run[0]}to{run[1]}"

    def _read(self, kind: str, schema: StructType, runs: list[tuple[int, int]]) -> DataFrame:
        schema = StructType([*schema.fields, StructField("run", StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.base}/{kind}").parquet(*[self._path(kind, r) for r in runs])

    def rows(self, runs: list[tuple[int, int]]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("part", IntegerType())])
        return self._read("rows", schema, runs) if runs else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, contents: int, run: tuple[int, int]) -> None:
        """One run of at most `contents` contents."""
        blocks = max(1, -(-contents // BLOCK_CONTENTS))
        block = _number(0) % blocks
        placed = rows.withColumn("part", F.floor(block / PART_BLOCKS).cast("int")).repartition("part")
        target = self._path("rows", run)
        placed.sortWithinPartitions("part", "content_hash").write.mode("overwrite").partitionBy("part").parquet(target)
        stored = self.spark.read.schema(StructType([self.schema["content_hash"]])).option("recursiveFileLookup", True).parquet(target)
        places = stored.select(block.alias("block"), F.explode(F.array(*_bits())).alias("place"))
        bloom = places.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")).withColumn("blocks", F.lit(blocks).cast("bigint"))
        bloom.write.mode("overwrite").parquet(self._path("bloom", run))

    def _known(self, batch: DataFrame, runs: list[tuple[int, int]]) -> DataFrame:
        """Hashes of the batch that a run holds."""
        bloom = self._read("bloom", BLOOM, runs)
        # one value per run
        sizes = bloom.groupBy("run").agg(F.max("blocks").alias("blocks")).collect()
        if not sizes:
            return batch.select("content_hash").limit(0)
        each = F.array(*[F.struct(F.lit(r.run).alias("run"), F.lit(r.blocks).alias("blocks")) for r in sizes])
        asked = batch.select("content_hash", F.explode(each).alias("_r")).select("content_hash", "_r.run", (_number(0) % F.col("_r.blocks")).alias("block"))
        met = asked.join(bloom.select("run", "block", "bits"), ["run", "block"])
        maybe = F.lit(True)
        for place in _bits():
            maybe = maybe & _is_set(F.col("bits"), place)
        target = f"{self.base}/maybe"
        met.where(maybe).select("run", F.floor(F.col("block") / PART_BLOCKS).cast("int").alias("part"), "content_hash").write.mode("overwrite").parquet(target)
        found = self.spark.read.schema("run string, part int, content_hash string").parquet(target).where("content_hash is not null")
        # at most (fanout - 1) per level
        hit = {r.run for r in found.select("run").distinct().collect()}
        held = [r for r in runs if f"b{r[0]}to{r[1]}" in hit]
        if not held:
            return found.select("content_hash").limit(0)
        self.read_runs += held
        return found.join(self.rows(held).select("run", "part", "content_hash"), ["run", "part", "content_hash"], "left_semi").select("content_hash")

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def add(self, files: DataFrame, batch: int) -> None:
        """Stores the contents of a batch that no earlier batch brought."""
        self.read_runs = []
        for _, parts in merges(batch - 1, self.fanout) if batch else []:
            for run in parts:
                for kind in ("rows", "bloom"):
                    self._delete(self._path(kind, run))
        pending = f"{self.base}/pending"
        self._unique(files).write.mode("overwrite").parquet(pending)
        mine = self.spark.read.schema(self.schema).parquet(pending)
        contents = mine.count()
        runs = cover(batch, self.fanout)
        fresh = mine.join(self._known(mine, runs), "content_hash", "left_anti").select(*self.schema.names) if runs and contents else mine
        self._write(fresh, contents, (batch, batch + 1))
        for run, parts in merges(batch, self.fanout):
            rows = self.rows(parts)
            self._write(rows.select(*self.schema.names), rows.count(), run)

    def stored(self) -> DataFrame:
        """The first file of every content so far."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/rows")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        ends = [int(n.rsplit("to", 1)[1]) for n in names if n.startswith("run=b")]
        return self.rows(cover(max(ends, default=0), self.fanout)).select(*self.schema.names)

