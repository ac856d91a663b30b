"""Rows of a case beside what is looked for in them.

What is looked for in a case (signals, words of records) is small beside the case's texts, but together they form far more
pairs than either has rows. So the texts of a case are dealt by document to groups of bounded size, what is looked for is sent to each
group, and a task reads first the one and then the other as they come: it holds what is looked for and one batch of texts, and no pair
is ever shuffled. More than `PIECE` things to look for in a case become pieces, each with a copy of the texts of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# rows of a group, and things to look for that a task holds
GROUP = 8192
PIECE = 200_000


def _parts(df: DataFrame, size: int) -> tuple[Column | None, list]:
    """Cases that need several parts of `size` rows; their number is bounded by the rows over the size."""
    n = F.ceil(F.count(F.lit(1)) / size).cast("int")
    return df.groupBy("case_id").agg(n.alias("n")).where("n > 1 and case_id is not null").collect()


def _with(df: DataFrame, parts: list, name: str) -> DataFrame:
    if not parts:
        return df.withColumn(name, F.lit(1))
    known = df.sparkSession.createDataFrame([tuple(r) for r in parts], f"case_id string, {name} int")
    return df.join(F.broadcast(known), "case_id", "left").withColumn(name, F.coalesce(name, F.lit(1)))


def beside(
    index: DataFrame, rows: DataFrame, spread: str, order: Sequence[str], run: Callable, schema: str, group: int | None = None, piece: int | None = None
) -> tuple[DataFrame, bool]:
    """What `run` makes of the rows of each case beside its index, and whether a row may have met several pieces.

    Both frames have case_id and otherwise names of their own. `run` gets Arrow batches with the columns of both: of every group first
    the index (`_kind` 0), then the rows (`_kind` 1) by `order`; a group has one value of case_id, `_group` and `_piece`. Rows of one value
    of `spread` stay together. A case without a name has no group.
    """
    groups, pieces = _parts(rows, group or GROUP), _parts(index, piece or PIECE)
    own = F.pmod(F.xxhash64(*[c for c in index.columns if c != "case_id"]), F.col("_pieces").cast("long")).cast("int")
    here = lambda df: _with(_with(df.where("case_id is not null"), groups, "_groups"), pieces, "_pieces")
    first = here(index).withColumns({"_piece": own, "_group": F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)), "_kind": F.lit(0)})
    dealt = F.pmod(F.xxhash64(spread), F.col("_groups").cast("long")).cast("int")
    then = here(rows).withColumns({"_group": dealt, "_piece": F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)), "_kind": F.lit(1)})
    keys = ["case_id", "_group", "_piece"]
    both = first.drop("_groups", "_pieces").unionByName(then.drop("_groups", "_pieces"), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "_kind", *order).mapInArrow(run, schema), bool(pieces)
