"""Connected components of an edge table, by hooking to the smallest neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deedloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of `edges` (a long, b long); root is the smallest vertex of its component.

    Each round hooks every vertex to its smallest neighbour, follows the hooks to their ends by doubling, and
    contracts: vertices shrink at least by half. Every table is written, so a lost executor costs one round only.
    No edges give no rows; loops and repeated edges are harmless; a null end is left out.
    """
    live = materialize(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.selectExpr("b as a", "a as b"))
        hook = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("p")))
        while True:
            # a vertex whose parent has another parent moves up; the last pass moves none
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("q")).where("p <> q")
            moved = materialize(hook.join(up, "p").select("v", F.col("q").alias("p")))
            if moved.isEmpty():
                break
            hook = materialize(hook.join(moved.select("v", F.col("p").alias("q")), "v", "left").select("v", F.coalesce("q", "p").alias("p")))
        if labels is None:
            labels = hook.withColumnRenamed("p", "root")
        else:
            step = hook.select(F.col("v").alias("root"), "p")
            labels = materialize(labels.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root")))
        left = live.join(hook.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
        ends = left.join(hook.select(F.col("v").alias("b"), F.col("p").alias("y")), "b").where("x <> y")
        live = materialize(ends.selectExpr("least(x, y) as a", "greatest(x, y) as b").distinct())
    return labels if labels is not None else live.selectExpr("a as v", "b as root")
