"""Connected groups of records that share keys, within a scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from deedloom.session import materialize


def connected(items: DataFrame, scope: Sequence[str], keys: Sequence[Column]) -> DataFrame:
    """(scope, ord, part): the smallest `ord` that a record reaches over records with a key in common.

    Each round hooks every group onto the smallest group at one of its keys, follows the hooks one step
    further and replaces groups by where they hang; keys with a single group left are done and drop out, so
    each round reads only what can still grow together. Keys are met by their minimum, never in pairs. A null
    key binds nothing. Rounds grow with the logarithm of the longest chain.
    """
    scope = list(scope)
    listed = F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("value")) for i, k in enumerate(keys)])
    edges = items.select(*scope, F.col("ord").alias("part"), F.explode(F.filter(listed, lambda k: k["value"].isNotNull())).alias("key"))
    edges = materialize(edges.distinct())
    hung: list[DataFrame] = []
    while True:
        least = edges.groupBy(*scope, "key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
        open_keys = materialize(least.where("low < high").drop("high"))
        if open_keys.isEmpty():
            break
        edges = edges.join(open_keys, [*scope, "key"])
        hooks = materialize(edges.groupBy(*scope, "part").agg(F.min("low").alias("to")).where("to < part"))
        # one step further where the target hangs as well
        second = hooks.select(*scope, F.col("part").alias("to"), F.col("to").alias("then"))
        hooks = materialize(hooks.join(second, [*scope, "to"], "left").select(*scope, "part", F.coalesce("then", "to").alias("to")))
        hung.append(hooks)
        moved = edges.drop("low").join(hooks, [*scope, "part"], "left")
        edges = materialize(moved.select(*scope, F.coalesce("to", "part").alias("part"), "key").distinct())
    out = items.select(*scope, "ord", F.col("ord").alias("part"))
    for hooks in hung:
        out = out.join(hooks, [*scope, "part"], "left").select(*scope, "ord", F.coalesce("to", "part").alias("part"))
    return materialize(out)
