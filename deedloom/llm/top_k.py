"""Exact top-k inner products by block-at-a-time pruning.

Vectors are documents and dimensions are terms. Equal vectors form one class, known by its first k + 1 rows, so a hot
vector is scored once. Classes are laid in document ranges (near the same of `PIVOTS` sampled pivots) and cut into
blocks of `BLOCK` that hold a forward index and the maximum and minimum of each term.

Queries go in chunks of at most `CHUNK` components, broadcast one after the other over the blocks. In a task each query
orders its blocks by summed term maxima (minima where its own weight is negative), scores whole blocks in that order in
growing waves and stops when the next bound falls below its k-th score. A first pass over the single best block of
every task gives each query a floor for the second, which covers all blocks. Blocks whose bound equals the k-th score
are scored too, so ties are decided exactly. Scores are matrix products in a float type that surely holds them.

Edge cases: vectors that are null, or hold a null or a non-finite component, take no part; missing components of
shorter vectors count as zero; the query's own row is left out once, other rows with the same id remain; repeated
queries give their rows repeatedly; rows without an id are candidates, last in ties; fewer rows than k give all of
them; an empty table gives an empty result; other columns are ignored. Components must stay below 2^63 after scaling
(larger ones saturate) and scores wrap beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deedloom.llm.common import columns, small_batches
from deedloom.operators.positions import position
from deedloom.session import materialize

K = 20
SCALE = 64
EVERY = 20
BLOCK = 32
PIVOTS = 128
# components of one broadcast chunk of queries, and queries worked on together
CHUNK, TOGETHER = 1 << 20, 1024
# components of the blocks that a task orders together
RANGE = 1 << 20


def scaled(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and v, the integer components floor(scale * x), of the rows that take part."""
    usable = F.col(column).isNotNull() & ~F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return columns(vectors, (id_column, "long"), (column, "array<double>")).where(usable).select(
        F.col(id_column).alias("id"), F.transform(F.col(column), lambda x: F.floor(x * scale)).alias("v")
    )


def classes(rows: DataFrame, k: int = K) -> DataFrame:
    """Equal vectors as one row: c (a number), v, first (smallest id), ids (its first k + 1 ids, nulls last).

    Spark limits every map task to k + 1 rows of a vector before the shuffle, so copies never meet in one task.
    """
    order = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    kept = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("_r", "id"))).alias("ids"))
    return materialize(
        kept.select(F.monotonically_increasing_id().alias("c"), "v", F.col("ids.id").alias("ids"), F.element_at("ids.id", 1).alias("first"))
    )


def _padded(values: list, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Lists of numbers as arrays."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def blocks(found: DataFrame, dim: int, size: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Blocks of near classes: c and first of each class, v (all components in a row), high and low per term.

    The pivots are a bounded sample by hash; they decide the order alone, never the result.
    """
    sample = found.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    shared = found.sparkSession.sparkContext.broadcast(_padded([r[0] for r in sample], dim).astype(np.float64))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value / np.maximum(1e-9, np.linalg.norm(shared.value, axis=1, keepdims=True))
        for batch in batches:
            sim = _padded(batch.column("v").to_pylist(), dim) @ points.T
            best = sim.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("first"), batch.column("v"), pa.array(best, pa.int64()), pa.array(-sim.max(axis=1), pa.float64())],
                names=["c", "first", "v", "pivot", "far"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []

        def block(rows: list) -> list:
            v = _padded([r[2] for r in rows], dim)
            return [[r[0] for r in rows], [r[1] for r in rows], v.ravel().tolist(), v.max(axis=0).tolist(), v.min(axis=0).tolist()]

        def emit(made: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64())) for c in zip(*made)], names=["c", "first", "v", "high", "low"])

        for batch in batches:
            kept += zip(*(batch.column(n).to_pylist() for n in ("c", "first", "v")))
            made = [block(kept[i : i + size]) for i in range(0, len(kept) - size + 1, size)]
            kept = kept[len(made) * size :]
            if made:
                yield emit(made)
        if kept:
            yield emit([block(kept)])

    ordered = found.select("c", "first", "v").mapInArrow(near, "c long, first long, v array<long>, pivot long, far double")
    ranges = ordered.repartitionByRange("pivot", "far", "c").sortWithinPartitions("pivot", "far", "c")
    lists = ", ".join(f"{n} array<long>" for n in ("c", "first", "v", "high", "low"))
    with small_batches(found.sparkSession):
        return materialize(ranges.mapInArrow(cut, lists))


class _Best:
    """Best k + 1 classes of each query of a group: score, class, first id; ties by first id, nulls last."""

    def __init__(self, keep: int, floor: np.ndarray):
        self.keep, self.floor, self.kth = keep, floor, floor.copy()
        self.rows = [np.empty(0, np.int64) for _ in range(5)]

    def add(self, found: list) -> None:
        """found: arrays (query, score, class, first, is null)."""
        if not found:
            return
        q, s, c, f, z = (np.concatenate([old, *new]) for old, new in zip(self.rows, zip(*found)))
        order = np.lexsort((c, f, z, -s, q))
        q, s, c, f, z = (x[order] for x in (q, s, c, f, z))
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.keep - 1
        self.kth[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.rows = [x[rank < self.keep] for x in (q, s, c, f, z)]


def _exact(a: np.ndarray, b: np.ndarray):
    """Type in which products of rows of a and b are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def search(block_rows: list, queries: np.ndarray, floor: np.ndarray, keep: int, only_best: bool = False) -> tuple[_Best, int]:
    """Best classes of each query among blocks (c, first, v, high, low), and how many (query, block) pairs were scored.

    `floor` holds scores that need not be undercut. With `only_best` a query takes its best block alone.
    """
    m, dim = queries.shape
    best = _Best(keep, floor)
    v = [np.asarray(b[2], np.int64).reshape(len(b[0]), dim) for b in block_rows]
    high, low = (np.array([b[i] for b in block_rows], np.int64).reshape(len(v), dim) for i in (3, 4))
    kind = _exact(queries, np.concatenate([high, low]))
    q = queries.astype(kind)
    if kind is np.int64:
        # sums may pass 64 bits, so no block is ruled out
        bound = np.full((m, len(v)), np.iinfo(np.int64).max)
    else:
        bound = (np.maximum(q, 0) @ high.astype(kind).T + np.minimum(q, 0) @ low.astype(kind).T).astype(np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, axis=1)
    at, wave, scored = 0, 1, 0
    live = np.arange(m)
    while at < len(v) and len(live):
        take = slice(at, at + wave)
        wanted = ranked[live, take] >= best.kth[live, None]
        who, which = np.nonzero(wanted)
        block_of, query_of = order[live[who], at + which], live[who]
        by_block = np.argsort(block_of, kind="stable")
        block_of, query_of = block_of[by_block], query_of[by_block]
        ends = np.flatnonzero(np.diff(block_of, append=-1)) + 1
        found, begin = [], 0
        for end in ends:
            b, mine = block_of[begin], query_of[begin:end]
            score = (q[mine] @ v[b].astype(kind).T).astype(np.int64)
            i, j = np.nonzero(score >= best.kth[mine, None])
            c, f = (block_rows[b][x] for x in (0, 1))
            nulls = np.array([x is None for x in f], np.int64)
            firsts = np.array([0 if x is None else x for x in f], np.int64)
            found.append((mine[i], score[i, j], np.asarray(c, np.int64)[j], firsts[j], nulls[j]))
            begin = end
        scored += len(block_of)
        best.add(found)
        at, wave = at + wave, wave * 2
        if only_best or at >= len(v):
            break
        live = live[ranked[live, at] >= best.kth[live]]
    return best, scored


def _pass(index: DataFrame, shared, floors, dim: int, keep: int, only_best: bool) -> DataFrame:
    """Best classes of the broadcast queries in every task's ranges: q, score, c, first."""
    most = max(1, RANGE // max(1, dim * BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        floor = floors.value if floors is not None else np.full(len(ids), np.iinfo(np.int64).min)
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                rows = list(zip(_lists(part.column("c")), part.column("first").to_pylist(), *(_lists(part.column(n)) for n in ("v", "high", "low"))))
                for lo in range(0, len(ids), TOGETHER):
                    hi = min(len(ids), lo + TOGETHER)
                    best, _ = search(rows, vectors[lo:hi], floor[lo:hi], keep, only_best)
                    q, s, c, f, z = best.rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][q]), pa.array(s), pa.array(c), pa.array(f, mask=z.astype(bool))], names=["q", "score", "c", "first"]
                    )

    return index.mapInArrow(run, "q long, score long, c long, first long")


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("first").asc_nulls_last(), "c")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep)


def search_all(index: DataFrame, queries: DataFrame, dim: int, k: int = K) -> list[DataFrame]:
    """Best k + 1 classes of every query class: written tables (q, c, score), one for each chunk of queries."""
    spark = queries.sparkSession
    per = max(1, CHUNK // max(1, dim))
    numbered = materialize(position(queries.select("c", "v"), [], {"part": F.shiftright("c", 33)}, ["c"], "at"))
    last = numbered.agg(F.max("at")).first()[0] or 0
    out = []
    for start in range(1, last + 1, per):
        rows = numbered.where(F.col("at").between(start, start + per - 1)).select("c", "v").toArrow()
        ids = rows.column("c").to_numpy()
        shared = spark.sparkContext.broadcast((ids, _padded(rows.column("v").to_pylist(), dim)))
        first = _ranked(_pass(index, shared, None, dim, k + 1, True), k + 1).where(F.col("_r") == k + 1).select("q", "score").toArrow()
        floor = np.full(len(ids), np.iinfo(np.int64).min)
        at = np.argsort(ids)
        floor[at[np.searchsorted(ids[at], first.column("q").to_numpy())]] = first.column("score").to_numpy()
        floors = spark.sparkContext.broadcast(floor)
        out.append(materialize(_ranked(_pass(index, shared, floors, dim, k + 1, False), k + 1).select("q", "c", "score")))
        shared.unpersist()
        floors.unpersist()
    return out


def top_k(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors, id_column, column, scale))
    found = classes(rows, k)
    dim = found.agg(F.max(F.size("v"))).first()[0] or 0
    asked = rows.where(F.col("id") % every == 0)
    # a repeated query counts; a hot query vector is one class with many ids, which are only joined at the end
    asked = materialize(asked.groupBy("v", "id").agg(F.count(F.lit(1)).alias("times")).join(found.select("v", "c"), "v").select("id", "times", "c"))
    wanted = found.join(asked.select("c").distinct(), "c", "left_semi")
    answers = search_all(blocks(found, dim), wanted, dim, k)
    schema = "q long, c long, score long"
    best = answers[0] if answers else spark.createDataFrame([], schema)
    for more in answers[1:]:
        best = best.unionByName(more)
    members = best.join(found.select("c", "ids"), "c").select(
        "q", "score", (F.col("c") == F.col("q")).alias("same"), F.explode("ids").alias("vec_id")
    )
    # the best k + 1 rows of a query class serve each of its rows: at most one of them is its own
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    short = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    lists = short.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score", "same"))).alias("rows"))
    own = F.array_position(F.transform("rows", lambda r: r["same"] & r["vec_id"].eqNullSafe(F.col("id"))), True)
    return (
        asked.join(lists, asked["c"] == lists["q"]).select("id", "times", own.alias("own"), "rows")
        .withColumn("rows", F.slice(F.filter("rows", lambda r, i: i + 1 != F.col("own")), 1, k))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(F.col("id").alias("query_id"), F.posexplode("rows").alias("rank", "r"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))
    )
