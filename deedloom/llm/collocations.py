"""Phrase collocation mining by SON partitioning.

1. Documents fall into `SHARDS` shards, which take blocks of ids so that a split of the input meets few of them. A shard
   is a logical part, never a task. Phrases of up to two words of a shard are counted completely: tasks count slices of
   text exactly, and the counts travel packed in arrays, by shard and hash range. Those with their proportionally
   lowered support (at least support * words of the shard / words of the language, rounded up) are locally frequent. A
   phrase with the global support has it in at least one shard.
2. Phrases of three and four words are mined in the same way, from places where every pair of words is frequent.
3. The union of all locally frequent phrases is a bitmap of hashes of bounded size. One more pass counts every phrase
   found in it globally, by its words: a hash that meets another only adds a phrase whose exact count then decides.

The bitmap has two bits per word of the corpus, at most 2^30. Beyond that it fills up and holds back less; the counts stay
exact. Scores, cuts and containment are equality joins on (language, phrase).

Edge cases: a null text has no words; a null language is `und`; texts are read whole; repeated rows count each; equal
scores go to the larger count, then to the smaller phrase in byte order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from deedloom.llm.common import UPPER, columns, small_enough
from deedloom.session import materialize

SUPPORT = 30
# a local support of at least two words needs fewer than SUPPORT / 2 shards
SHARDS = 8
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
# a phrase goes if a longer one around it has this share of its count
COVER, OF = 80, 100
ENDS = ".,;:!?\n\v\f\r"
# lower case, piece ends as line ends, tabs as blanks
BYTES = bytes.maketrans((UPPER + ENDS + "\t").encode(), (UPPER.lower() + "\n" * len(ENDS) + " ").encode())
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
# consecutive ids of a shard, words of a slice, packed counts aimed at for one hash range, bits of the bitmap
ID_BLOCK = 4096
SLICE = 1 << 21
RANGE = 1 << 20
MOST_BITS = 30


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Slice:
    """Words of many texts as numbers, with exact counts of their phrases."""

    def __init__(self, words: list[bytes], hashes: np.ndarray, lang: str, ids: list[int], lengths: list[int]):
        import xxhash

        self.words, self.hashes = words, hashes
        self.seed = xxhash.xxh3_64_intdigest(lang)
        self.ids = np.array(ids, np.int64)
        size = np.array(lengths, np.int64)
        # words from here to the end of the piece
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(ids))
        self.pairs: np.ndarray | None = None

    def hash(self, places: np.ndarray, order: int) -> np.ndarray:
        """64-bit hashes of the phrases of `order` words at the places."""
        h = np.full(len(places), (self.seed + order) % (1 << 64), np.uint64)
        for k in range(order):
            h = _mixed(h ^ self.hashes[self.ids[places + k]])
        return h

    def counts(self, order: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of every phrase of `order` words that begins at the places `at`."""
        if order == 1:
            key = self.ids[at]
        elif order == 2:
            key = self.ids[at] << 32 | self.ids[at + 1]
        else:
            # numbers of pairs make longer phrases exact keys of 64 bits
            key = self.pair_numbers()[at] << 32 | (self.ids[at + 2] if order == 3 else self.pair_numbers()[at + 2])
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return at[first], n

    def pair_numbers(self) -> np.ndarray:
        if self.pairs is None:
            after = np.append(self.ids[1:], 0)
            self.pairs = np.unique(self.ids << 32 | after, return_inverse=True)[1].astype(np.int64)
        return self.pairs

    def frequent_pairs(self, known: Bitmap) -> np.ndarray:
        """Marks the places of pairs of words that the bitmap holds."""
        good = np.zeros(len(self.ids) + LONGEST, bool)
        at = np.flatnonzero(self.left >= 2)
        if len(at):
            pairs, first, which = np.unique(self.ids[at] << 32 | self.ids[at + 1], return_index=True, return_inverse=True)
            good[at] = known.holds(self.hash(at[first], 2))[which]
        return good

    def places(self, order: int, good: np.ndarray | None = None) -> np.ndarray:
        """Places of phrases of `order` words, all of whose pairs are good."""
        fit = self.left >= order
        if good is not None:
            for k in range(order - 1):
                fit = fit & good[k : k + len(fit)]
        return np.flatnonzero(fit)

    def phrases(self, places: np.ndarray, order: int) -> list[str]:
        words, rows = self.words, np.stack([self.ids[places + k] for k in range(order)], axis=1).tolist()
        return [b" ".join([words[i] for i in r]).decode() for r in rows]


class Bitmap:
    """Set of hashes by their leading bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Slice]]:
    """Language, shard, local support and words of the texts of a task, a bounded number of words at a time."""
    import xxhash

    numbers, groups, held = _Numbers(), {}, 0

    def drain() -> Iterator[tuple[str, int, int, Slice]]:
        words = list(numbers)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        for (lang, shard, need), (ids, lengths) in groups.items():
            yield lang, shard, need, Slice(words, hashes, lang, ids, lengths)

    for batch in batches:
        for lang, shard, need, text in zip(*(batch.column(n).to_pylist() for n in ("lang", "shard", "need", "text"))):
            ids, lengths = groups.setdefault((lang, shard, need), ([], []))
            for piece in text.encode().translate(BYTES).split(b"\n"):
                found = piece.split()
                if found:
                    ids.extend(map(numbers.__getitem__, found))
                    lengths.append(len(found))
                    held += len(found)
            if held >= SLICE:
                yield from drain()
                numbers, groups, held = _Numbers(), {}, 0
    yield from drain()


def _mapped(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str) -> DataFrame:
    """mapInArrow of columns in the order of the schema."""
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for cols in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, fields)


def prepared(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """lang, shard and text of every document."""
    block = F.floor(F.col("doc_id") / ID_BLOCK)
    return columns(docs, ("doc_id", "long"), ("lang", "string"), ("text", "string")).select(
        F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64(block), F.lit(shards)).cast("int").alias("shard"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def word_totals(texts: DataFrame) -> DataFrame:
    """lang, shard and words of each pair that has any document; a written table."""
    counted = texts.groupBy("lang", "shard").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("words"))
    return materialize(counted)


def mine_shards(texts: DataFrame, orders: tuple[int, ...], ranges: int, bits: int, pairs=None) -> DataFrame:
    """Locally frequent phrases of the orders: rows of bitmap positions, packed.

    `texts` has lang, shard, need and text. Counts are summed by shard and hash range; with `pairs`, the broadcast
    bitmap of frequent phrases of up to two words, only places of frequent pairs are counted.
    """
    width = 64 - (ranges - 1).bit_length() if ranges > 1 else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known = Bitmap(pairs.value) if pairs is not None else None
        for _, shard, need, part in _slices(batches):
            good = part.frequent_pairs(known) if known is not None else None
            got = [(part.hash(at, k), n) for k in orders for at, n in (part.counts(k, part.places(k, good)),)]
            keys, n = np.concatenate([h for h, _ in got]), np.concatenate([c for _, c in got])
            order = np.argsort(keys)
            keys, n = keys[order], n[order].astype(np.int32)
            piece = (keys >> np.uint64(width)).astype(np.int64) if width else np.zeros(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(piece, prepend=-1))
            ends = np.append(cuts[1:], len(keys)) if len(cuts) else cuts
            if len(cuts):
                yield [
                    [shard] * len(cuts), piece[cuts], [keys[a:b].tobytes() for a, b in zip(cuts, ends)],
                    [n[a:b].tobytes() for a, b in zip(cuts, ends)], [need] * len(cuts),
                ]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        def settle(held: list) -> list:
            keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _, _ in held])
            n = np.concatenate([np.frombuffer(c, np.int32) for _, c, _ in held]).astype(np.int64)
            need = np.concatenate([np.full(len(k) // 8, d, np.int64) for k, _, d in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            # where hashes of two languages meet, the lower support stands
            frequent = np.add.reduceat(n[order], heads) >= np.minimum.reduceat(need[order], heads)
            at = np.unique(keys[heads][frequent] >> np.uint64(64 - bits))
            return [[at.astype(np.uint32).tobytes()]]

        held, here = [], None
        for batch in batches:
            for shard, piece, keys, n, need in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, piece) != here and held:
                    yield settle(held)
                    held = []
                here = (shard, piece)
                held.append((keys, n, need))
        if held:
            yield settle(held)

    packed = _mapped(texts, count, "shard int, piece long, keys binary, n binary, need long")
    placed = packed.repartition(ranges * SHARDS, "shard", "piece").sortWithinPartitions("shard", "piece")
    return materialize(_mapped(placed, reduce, "at binary"))


def union(mined: DataFrame, bits: int, onto: np.ndarray | None = None) -> np.ndarray:
    """Bitmap of all positions, streamed to the driver part by part; its size is 2^bits bits, whatever the rows."""
    out = np.zeros(1 << (bits - 3), np.uint8) if onto is None else onto.copy()
    for row in mined.coalesce(8).toLocalIterator():
        at = np.frombuffer(row["at"], np.uint32)
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def count_candidates(texts: DataFrame, candidates, support: int = SUPPORT) -> DataFrame:
    """Exact counts of all candidate phrases with the support: lang, size (words), phrase, f; a written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known = Bitmap(candidates.value)
        for lang, _, _, part in _slices(batches):
            good = part.frequent_pairs(known)
            for k in range(1, LONGEST + 1):
                at, n = part.counts(k, part.places(k, good))
                stay = known.holds(part.hash(at, k))
                at, n = at[stay], n[stay]
                for i in range(0, len(at), 20000):
                    names = part.phrases(at[i : i + 20000], k)
                    yield [[lang] * len(names), [k] * len(names), names, n[i : i + 20000]]

    found = _mapped(texts, count, "lang string, size int, phrase string, f long")
    return materialize(found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= support))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 4 words with at least `support` occurrences in a language (lang, size, phrase, f), and words per language."""
    spark = docs.sparkSession
    texts = prepared(docs, shards)
    totals = word_totals(texts)
    of_lang = totals.groupBy("lang").agg(F.sum("words").alias("n"))
    words = totals.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(2 * words + 1))))
    # up to two counts a word, spread over the shards
    ranges = 1 << max(0, math.ceil(math.log2(max(1, 2 * words / SHARDS / RANGE))))
    support_of = (F.lit(support) * F.col("words").cast("decimal(20,0)") + F.col("n") - 1).cast("decimal(38,0)")
    needs = materialize(
        totals.join(of_lang, "lang").where("words > 0").select("lang", "shard", F.floor(support_of / F.col("n")).cast("long").alias("need"))
    )
    needed = texts.join(small_enough(needs, 128), ["lang", "shard"])
    short = union(mine_shards(needed, (1, 2), ranges, bits), bits)
    pairs = spark.sparkContext.broadcast(short)
    every = union(mine_shards(needed, (3, 4), ranges, bits, pairs), bits, short)
    pairs.unpersist()
    candidates = spark.sparkContext.broadcast(every)
    found = count_candidates(needed, candidates, support)
    candidates.unpersist()
    return found, of_lang


def _phrase(words: Column | str, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """The best `top` phrases of each language: lang, rank, phrase, a, l, r, n, score (exact whole numbers)."""
    found, of_lang = frequent_phrases(docs, support, shards)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    longer = found.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", "size", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "size", "a", "k", _phrase("w", 1, F.col("k")).alias("left"),
        _phrase("w", F.col("k") + 1, F.col("size")).alias("right"),
    )
    counts = found.select("lang", "phrase", "f")
    sided = parts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr(f"cast(({scale} * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r) as long)")
    scored = sided.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = longer.where("size > 2").select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("len")).select(
        "lang", "f", "w", "len", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("len") + 1)).alias("start")
    )
    around = inner.groupBy("lang", _phrase("w", F.col("start"), F.col("len")).alias("phrase")).agg(F.max("f").alias("cover"))
    free = scored.join(around, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (wide("cover") * OF < wide("a") * COVER))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(of_lang, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
