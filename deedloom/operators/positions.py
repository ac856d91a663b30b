"""Positions and running totals that stay parallel when one key holds most rows.

A plain window partitioned by the key would sort that key in a single task. Here rows fall into
ordered blocks inside a key; each block is numbered on its own and a small table of block totals
supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from deedloom.session import materialize


def _joined(df: DataFrame, offsets: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = offsets
    cond = F.lit(True)
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_o_{c}")
        cond = cond & df[c].eqNullSafe(F.col(f"_o_{c}"))
    return df.join(renamed, cond, "left").drop(*[f"_o_{c}" for c in on])


def position(
    df: DataFrame, keys: Sequence[str], blocks: dict[str, Column], order: Sequence[Column | str], out: str
) -> DataFrame:
    """1-based position of each row within `keys`, ordered by the block columns and then by `order`.

    `blocks` are expressions that agree with the wanted order (a coarse prefix of it).
    """
    names = [f"_b{i}_{n}" for i, n in enumerate(blocks)]
    marked = df.withColumns(dict(zip(names, blocks.values())))
    sizes = marked.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pos_off"))
    local = marked.withColumn("_pos_local", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))
    return (
        _joined(local, offsets, [*keys, *names])
        .withColumn(out, (F.col("_pos_off") + F.col("_pos_local")).cast("bigint"))
        .drop("_pos_off", "_pos_local", *names)
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row within `keys` by the columns `order`, which tell the rows of a key apart.

    For orders without a coarse prefix of few values: the rows are sorted by ranges and written once with their place; what is
    added up is one row per key and range, however large or small the keys and the groups of the order are.
    """
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialize(rows.withColumn("_place", F.monotonically_increasing_id()))
    # the upper bits of a place are the range
    ranged = placed.withColumn("_range", F.shiftright("_place", 33))
    runs = ranged.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(runs.select(*keys, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_pos_off")))
    return (
        _joined(ranged, offsets, [*keys, "_range"])
        .withColumn(out, (F.col("_pos_off") + F.col("_place")).cast("bigint"))
        .drop("_pos_off", "_place", "_range")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = 512
) -> DataFrame:
    """Sum of `value` over the rows before this one within `keys`, by the integer column `order`."""
    marked = df.withColumns({"_blk": F.floor(F.col(order) / block), "_v": value})
    totals = marked.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_blk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_pos_off"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumn("_pos_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return (
        _joined(local, offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_pos_off") + F.col("_pos_in")).cast("bigint"))
        .drop("_pos_off", "_pos_in", "_blk", "_v")
    )


def first_per_key(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key. Spark limits every map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")
