"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Words are counted per document and summed per source. Targets share `share` times all words by weight; a
   source whose target would pass `repeat` times its words stops there and the excess is shared again.
2. All blocks are given to sources by highest quotients weight / (2 * seats + 1). The seats of a source are handed
   to its shards (bounded random parts of a source) in the same way through a tree of `FAN` children a node, so no
   step sees more than `FAN` numbers at once, whatever the number of sources or shards.
3. A shard lays its documents end to end in seeded order, takes whole passes first and then the rest of its quota
   as blocks chosen at an even pace from a seeded start. What a document gives follows from its offset alone.

A hot source becomes many shards, so no task holds a source. Counts travel as five narrow columns; texts never do.

Edge cases: a null or empty text has size 0 and gives nothing; documents without source form the last source;
repeated rows count as documents of their own; equal quotients go to the lower child; an empty table gives an empty
result; other columns are ignored. Reruns give the same rows, as every choice is a hash of values and the seed.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window, functions as F

from deedloom.llm.common import columns
from deedloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
# tokens of a block; quotas are computed in closed form, so many small blocks cost nothing
BLOCK = 16
# words aimed at for one shard; a document counts as ROW_WORDS more, so that many empty ones spread too
SHARD_WORDS = 16384
ROW_WORDS = 32
FAN = 256
SEED = 20


def apportion(seats: int, weights: list[int]) -> list[int]:
    """Sainte-Lague seats by highest quotients w / (2s + 1); ties to the lower index.

    Starts from seats that every divisor method solution surely includes and hands out the few that are left.
    """
    total, n = sum(weights), len(weights)
    if total == 0 or seats <= 0:
        return [0] * n
    # with the divisor total / (seats - n), rounding up each share by a half never gives more than `seats`
    safe = max(0, seats - n)
    got = [(2 * w * safe + total) // (2 * total) for w in weights]
    left = seats - sum(got)
    if left <= 0:
        got, left = [w * safe // total for w in weights], seats - sum(w * safe // total for w in weights)
    heap = [_Quotient(w, 2 * s + 1, i) for i, (w, s) in enumerate(zip(weights, got)) if w]
    heapq.heapify(heap)
    for _ in range(left):
        best = heap[0]
        got[best.at] += 1
        heapq.heapreplace(heap, _Quotient(best.weight, best.odd + 2, best.at))
    return got


class _Quotient:
    """Exact order of the fractions weight / odd, largest first."""

    __slots__ = ("weight", "odd", "at")

    def __init__(self, weight: int, odd: int, at: int):
        self.weight, self.odd, self.at = weight, odd, at

    def __lt__(self, other: _Quotient) -> bool:
        a, b = self.weight * other.odd, other.weight * self.odd
        return a > b or a == b and self.at < other.at


def _depth(n: int) -> int:
    """Levels of a tree with FAN children a node and n leaves."""
    return max(1, math.ceil(math.log(max(n, 1), FAN) - 1e-9))


def _hand_down(roots: DataFrame | int, leaves: DataFrame, depth: int) -> DataFrame:
    """Quotas of the leaves (a, b, weight) below roots (a, q), or below one root of that many seats: columns a, b, q."""
    split = F.udf(apportion, "array<long>")
    now = roots if isinstance(roots, int) else roots.select("a", F.lit(0).cast("long").alias("b"), "q")
    for level in reversed(range(depth)):
        node = F.floor(F.col("b") / F.lit(FAN**level)).cast("long")
        below = leaves.groupBy("a", node.alias("c")).agg(F.sum("weight").alias("w"))
        families = below.groupBy("a", F.floor(F.col("c") / FAN).cast("long").alias("b")).agg(
            F.array_sort(F.collect_list(F.struct("c", "w"))).alias("kids")
        )
        given = families.withColumn("q", F.lit(now).cast("long")) if isinstance(now, int) else families.join(now, ["a", "b"])
        shared = given.withColumn("qs", split("q", F.col("kids.w")))
        now = shared.select("a", F.explode(F.arrays_zip(F.col("kids.c").alias("c"), F.col("qs").alias("q"))).alias("k")).select(
            "a", F.col("k.c").alias("b"), F.col("k.q").alias("q")
        )
    return now


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every document."""
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return columns(docs, ("doc_id", "long"), ("source", "string"), ("text", "string")).select(
        "doc_id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size")
    )


def _ranked(src: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last; only counts per partition meet in one place."""
    placed = materialize(
        src.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_p", F.shiftright("_m", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    rank = F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offset, "_p").withColumn("rank", rank.cast("long")).drop("_m", "_p", "_o")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """One row per source: source, rank, source_size, docs, target. Each round is one aggregate over sources."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = materialize(_ranked(src).withColumn("weight", weight))
    everything = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    factor, seen = 0.0, None
    while True:
        full = F.col("weight") * F.lit(factor) >= repeat * F.col("source_size")
        capped, free = src.agg(
            F.coalesce(F.sum(F.when(full, repeat * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if free == 0 or (capped, free) == seen:
            break
        seen, factor = (capped, free), (share * everything - capped) / free
    share_of = F.least(F.lit(float(repeat)) * F.col("source_size"), F.col("weight") * F.lit(factor))
    return src.withColumn("target", share_of.cast("double"))


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, shard."""
    sized = materialize(sizes(docs))
    src = materialize(targets(sized, weights, share, repeat))
    total, sources, most = src.agg(
        F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1)), F.coalesce(F.max(F.col("source_size") + ROW_WORDS * F.col("docs")), F.lit(0))
    ).first()
    seats = math.floor(total / block + 0.5)

    shards = F.greatest(F.lit(1), F.ceil((F.col("source_size") + ROW_WORDS * F.col("docs")) / SHARD_WORDS)).cast("long")
    placed = (
        sized.join(src.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), shards))
    )
    parts = materialize(placed.groupBy("rank", "shard").agg(F.sum("size").alias("words")))
    of_source = _hand_down(
        seats,
        src.select(F.lit(0).cast("long").alias("a"), F.col("rank").alias("b"), F.round(F.col("target") * 1024).cast("long").alias("weight")),
        _depth(sources),
    )
    of_shard = _hand_down(
        of_source.select(F.col("b").alias("a"), "q"),
        parts.select(F.col("rank").alias("a"), F.col("shard").alias("b"), F.col("words").alias("weight")),
        _depth(math.ceil(most / SHARD_WORDS)),
    )
    plan = parts.join(of_shard.select(F.col("a").alias("rank"), F.col("b").alias("shard"), "q"), ["rank", "shard"]).selectExpr(
        "rank", "shard", f"cast(q * {block} as long) as want", "words", f"words div {block} as blocks",
    ).selectExpr(
        "*", f"case when words = 0 then 0 else least({repeat}, want div words) end as passes",
    ).selectExpr(
        "rank", "shard", "passes", "blocks",
        f"case when passes = {repeat} then 0 else least(blocks, cast(round((want - passes * words) / {block}) as long)) end as drawn",
        f"pmod(xxhash64(rank, shard, {seed}), greatest(1, blocks)) as start",
    )
    inside = Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def drawn_before(x: str) -> str:
        y = f"least({x}, blocks * {block})"
        chosen = f"(({y} div {block} + %d) * drawn + start) div greatest(1, blocks)"
        return f"({block} * ({chosen % 0}) + {y} % {block} * (({chosen % 1}) - ({chosen % 0})))"

    return lined.join(plan, ["rank", "shard"]).selectExpr(
        "doc_id", "size", "source_size", "target",
        f"cast(passes * size + {drawn_before('(at + size)')} - {drawn_before('at')} as long) as taken",
        "source", "shard",
    )
