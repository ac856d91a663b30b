"""SimHash near-duplicates with bit-sliced comparison.

1. A fingerprint of 64 bits per document; equal ones are merged at once, so copies cost one row.
2. Two fingerprints within the radius (3) agree on at least one of four groups of bits. Each fingerprint stands in
   four buckets, one per group. A bucket above `BUCKET` is split again: its members agree on the fixed bits, so
   their free bits are cut into four groups in turn, which stays complete. What is still too large after `LEVELS`
   is cut into blocks that are compared two by two, so that no task gets a bucket whole.
3. A task holds its fingerprints vertically, one bit vector per plane, and compares every member with the one `d`
   places on, 64 pairs to a machine word: planes are added into carry-save counters whose overflow marks a distance
   beyond the radius, and words whose pairs have all overflown are abandoned. Buckets that have become one
   component leave the comparison. A task gives at most one edge per member, never all pairs.
4. Connected components of those edges; the smallest document id is carried at the end.

`keep_one_similar` serves a pipeline that wants a similarity and not a number of bits. Its fingerprints have `WIDE` words of
64 bits over distinct five-word shingles. Two sets of Jaccard J have an angle near acos(2J / (1 + J)), so J >= 0.8 means at
most about 15 of 100 bits apart; `WIDE_RADIUS` is that distance with a margin of one standard deviation for the estimate.
Pairs are met in buckets of `BAND` bits (at J = 0.8 a pair shares one with a chance of 0.91, at 0.85 of 0.98) and compared by
the same planes and counters over all bits. Equal texts always share everything.

Edge cases: a null or empty text has fingerprint 0 and is linked like any other; fewer than three words are one
shingle; very long texts are read whole; a document without id has a fingerprint and a component but names none
(the component id is null if no member has one); repeated rows share everything; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from deedloom.llm.common import columns, free_name, lower_blank_words
from deedloom.llm.components import components
from deedloom.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET = 1024
LEVELS = 3
# rows that a task compares at once
CHUNK = 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
# stages that ask for similarity: shingle, words of a fingerprint, bytes of a band, radius for Jaccard 0.8
WIDE_SHINGLE, WIDE, BAND_BYTES, WIDE_RADIUS = 5, 8, 2, 84


def fingerprint(words: list[bytes]) -> int:
    """A bit is set if more than half of the shingle hashes have it."""
    import xxhash

    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        part = hashed[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """Fingerprint of each text as a signed long."""
    codes = np.fromiter((fingerprint(lower_blank_words(t)) for t in texts), np.uint64, len(texts))
    return pd.Series(codes.view(np.int64))


def wide_fingerprint(words: list[bytes], shingle: int = WIDE_SHINGLE, wide: int = WIDE) -> bytes:
    """`wide` independent fingerprints of 64 bits over the distinct shingles, as bytes; zeros for no words."""
    import xxhash

    if not words:
        return bytes(8 * wide)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    hashed = np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))
    ones = np.zeros((wide, 64), np.int64)
    for at in range(0, len(hashed), 1 << 12):
        part = hashed[at : at + (1 << 12)]
        for k in range(wide):
            x = (part ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > len(hashed)).ravel(), bitorder="little").tobytes()


@F.pandas_udf(T.BinaryType())
def wide_fingerprint_of(texts: pd.Series) -> pd.Series:
    """Wide fingerprint of each text."""
    return pd.Series([wide_fingerprint(lower_blank_words(t)) for t in texts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""
    return columns(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", fingerprint_of("text").alias("fp"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(mask: int) -> list[int]:
    """The mask with each quarter of its free bits fixed as well."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _in_buckets(df: DataFrame, masks: dict[int, list[int]] | None) -> DataFrame:
    """fp, mask: one row for each finer mask (from no mask at all if `masks` is None)."""
    if masks is None:
        options = F.array(*[F.lit(signed(m)) for m in finer(0)])
    else:
        pairs = [x for m, fine in masks.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(f)) for f in fine]))]
        options = F.element_at(F.create_map(*pairs), F.col("mask"))
    return df.select("fp", F.explode(options).alias("mask"))


def buckets(codes: DataFrame, limit: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """fp, mask, bits, pair: every two fingerprints within the radius share a (mask, bits, pair)."""
    masks = finer(0)
    todo, done = _in_buckets(codes, None), []
    for level in range(1, levels + 1):
        todo = materialize(todo.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))))
        large = materialize(todo.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        marked = todo.join(large, ["mask", "bits"], "left")
        done.append(marked.where("n is null").select("fp", "mask", "bits", F.lit("").alias("pair")))
        hot = marked.where("n is not null")
        if large.isEmpty():
            break
        if level == levels:
            # blocks of half a bucket, met two by two
            parts = F.ceil(F.col("n") / (limit // 2)).cast("int")
            own = hot.select("fp", "mask", "bits", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int").alias("own"))
            met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> own")
            done.append(met.select("fp", "mask", "bits", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("pair")))
        else:
            todo = _in_buckets(hot, {m: finer(m) for m in masks})
            masks = [f for m in masks for f in finer(m)]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


class _Planes:
    """Fingerprints of a chunk as one bit vector per bit, and the bucket of each. Codes are words or rows of words."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray, at: np.ndarray):
        self.bucket, self.at, n = bucket, at, len(codes)
        words = -(-n // 64)
        bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
        packed = np.zeros((bits.shape[1], 8 * words), np.uint8)
        packed[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes, self.n = packed.view(np.uint64), n

    def pairs(self, d: int, radius: int) -> np.ndarray:
        """Places i such that i and i + d share a bucket and differ in at most `radius` bits."""
        n = self.n - d
        same = np.zeros(self.planes.shape[1] * 8, np.uint8)
        same[: -(-n // 8)] = np.packbits(self.bucket[:n] == self.bucket[d:], bitorder="little")
        words = np.flatnonzero(same.view(np.uint64))
        over = ~same.view(np.uint64)[words]
        # counters start so high that `radius` more ones fit and the next one overflows
        width = max(1, radius.bit_length())
        spare = (1 << width) - 1 - radius
        counters = [np.full(len(words), FULL if spare >> k & 1 else np.uint64(0)) for k in range(width)]
        skip, turn = divmod(d, 64)
        wide = self.planes.shape[1]
        for block in range(0, len(self.planes), 8):
            if not len(words):
                break
            plane = self.planes[block : block + 8]
            far = np.where(words + skip < wide, plane[:, np.minimum(words + skip, wide - 1)], np.uint64(0))
            if turn:
                after = np.where(words + skip + 1 < wide, plane[:, np.minimum(words + skip + 1, wide - 1)], np.uint64(0))
                far = (far >> np.uint64(turn)) | (after << np.uint64(64 - turn))
            for carry in plane[:, words] ^ far:
                for k in range(width):
                    counters[k], carry = counters[k] ^ carry, counters[k] & carry
                over |= carry
            live = np.flatnonzero(over != FULL)
            if 2 * len(live) <= len(words):
                words, over, counters = words[live], over[live], [c[live] for c in counters]
        near = np.unpackbits((~over).view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        row, lane = np.nonzero(near)
        return words[row] * 64 + lane


def linked(codes: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each place the smallest place of its component inside its bucket. Equal buckets stand together."""
    root = np.arange(len(codes))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    sizes = np.bincount(bucket)
    keep = np.flatnonzero(sizes[bucket] > 1)
    chunk, d, compact = None, 0, True
    while True:
        d += 1
        if compact:
            # only buckets longer than the distance that are not one component yet
            inside = bucket[keep]
            first = np.full(len(sizes), len(codes))
            np.minimum.at(first, inside, root[keep])
            apart = np.zeros(len(sizes), bool)
            apart[inside[root[keep] != first[inside]]] = True
            keep = keep[(sizes[inside] > d) & apart[inside]]
            if not len(keep):
                return root
            chunk = _Planes(codes[keep], bucket[keep], keep)
        if d >= chunk.n:
            return root
        i = chunk.pairs(d, radius)
        a, b = chunk.at[i], chunk.at[i + d]
        new = np.flatnonzero(root[a] != root[b])
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        while len(new):
            up = root[root]
            if (up == root).all():
                break
            root = up
        compact = d < 8 or d % 16 == 0


def edges(placed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) from each member of a bucket to the first of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            first = linked(fp.view(np.uint64), key, radius)
            moved = np.flatnonzero(first != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[first[moved]])], names=["a", "b"])

        fp, key = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False)))
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
            if len(fp) >= CHUNK:
                # a bucket that may go on stays for the next round; hashed keys only group, equality is by rank below
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield compare(fp[:cut], np.unique(key[:cut], return_inverse=True)[1])
                    fp, key = fp[cut:], key[cut:]
        if len(fp):
            yield compare(fp, np.unique(key, return_inverse=True)[1])

    # buckets whose hashes clash are compared together, which adds true links only
    hashed = placed.select("fp", F.xxhash64("mask", "bits", "pair").alias("key"))
    return hashed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document, and (fp, root, low) of every fingerprint: its component and smallest id."""
    codes = materialize(fingerprints(docs))
    distinct = materialize(codes.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(edges(buckets(distinct.select("fp"))))
    rooted = distinct.join(found.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return codes, materialize(rooted)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    codes, rooted = grouped(docs)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialize(rooted.join(lowest, "root").select("fp", "component_id"))
    return codes.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bands(codes: DataFrame, limit: int = BUCKET) -> DataFrame:
    """v, code, key: wide fingerprints that agree on a band share a key. Large buckets become blocks met two by two."""
    each = F.explode(F.expr(f"transform(sequence(0, {8 * WIDE // BAND_BYTES - 1}), i -> struct(i as band, substring(code, i * {BAND_BYTES} + 1, {BAND_BYTES}) as bits))"))
    placed = codes.select("v", each.alias("b")).select("v", F.xxhash64("b.band", "b.bits").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    many = materialize(sizes.where("n > 1"))
    # the planner takes the exploded bands for a small part of the codes' file, though they are many times as many rows, and would broadcast them
    shared = placed.join(many.hint("merge"), "bucket")
    parts = F.ceil(F.col("n") / (limit // 2)).cast("int")
    own = shared.withColumn("parts", F.when(F.col("n") > limit, parts).otherwise(1)).withColumn("own", F.pmod(F.xxhash64("v"), F.col("parts").cast("long")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or other <> own")
    return met.select("v", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key")).join(codes.select("v", "code").hint("merge"), "v")


def wide_edges(placed: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """Edges (a, b) from each member of a bucket of wide fingerprints to the first of its component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(v: np.ndarray, code: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            first = linked(code, np.unique(key, return_inverse=True)[1], radius)
            moved = np.flatnonzero(first != np.arange(len(v)))
            return pa.RecordBatch.from_arrays([pa.array(v[moved]), pa.array(v[first[moved]])], names=["a", "b"])

        v, code, key = np.empty(0, np.int64), np.empty((0, WIDE), np.uint64), np.empty(0, np.int64)
        for batch in batches:
            v = np.concatenate((v, batch.column("v").to_numpy(zero_copy_only=False)))
            key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
            code = np.concatenate((code, np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(-1, WIDE)))
            if len(v) >= CHUNK // 4:
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield compare(v[:cut], code[:cut], key[:cut])
                    v, code, key = v[cut:], code[cut:], key[cut:]
        if len(v):
            yield compare(v, code, key)

    # buckets whose hashes clash are compared together, which adds true links only
    return placed.select("v", "code", "key").repartition("key").sortWithinPartitions("key", "v").mapInArrow(run, "a long, b long")


def grouped_wide(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document, and (fp, root, low) of every wide fingerprint."""
    codes = materialize(columns(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", wide_fingerprint_of("text").alias("fp")))
    distinct = materialize(codes.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("v", F.monotonically_increasing_id()))
    found = components(wide_edges(bands(distinct.select("v", F.col("fp").alias("code")))))
    rooted = distinct.join(found, "v", "left").select("fp", F.coalesce("root", "v").alias("root"), "low")
    return codes, materialize(rooted)


def similar(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id of its group of similar documents."""
    codes, rooted = grouped_wide(docs)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return codes.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """One document of each group of similar documents, chosen as in `keep_one`."""
    return _one_of_each(docs, *grouped_wide(docs), wide_fingerprint_of)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with its own columns: that of the smallest id, a null only if there is no other.

    Rows that share their id with another row are few or none; among them the row of the smallest text stays.
    """
    return _one_of_each(docs, *grouped(docs), fingerprint_of)


def _one_of_each(docs: DataFrame, codes: DataFrame, rooted: DataFrame, of) -> DataFrame:
    i, f, r = (free_name(docs, n) for n in ("id", "fp", "row"))
    # per component the smallest id, and of the fingerprints that have it the smallest
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("b")
    best = materialize(rooted.groupBy("root").agg(first).select(F.col("b.low").alias(i), F.col("b.fp").alias(f)))
    several = materialize(codes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(i)))
    same = docs["doc_id"].eqNullSafe(F.col(i))
    single = docs.join(best.select(i).distinct(), same, "left_semi").join(several, same, "left_anti")
    packed = docs.join(several, same, "left_semi").select(
        docs["doc_id"].alias("d"), of(docs["text"]).alias("p"), F.coalesce(docs["text"], F.lit("")).alias("t"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(r)
    )
    chosen = packed.groupBy("d", "p").agg(F.min_by(r, "t").alias(r))
    multiple = chosen.join(best, F.col("d").eqNullSafe(F.col(i)) & (F.col("p") == F.col(f)), "left_semi").select(f"{r}.*")
    return single.unionByName(multiple)
