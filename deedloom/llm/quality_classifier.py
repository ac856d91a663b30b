"""Quality classifier by importance resampling.

Words and word pairs are hashed into 2^`BITS` buckets. Two generative models are counted: the target (documents
labelled good) and the raw text (all documents). The log weight of a document is the sum over its n-grams of
log(target / raw); raw counts are scaled to the size of the target and both get `PRIOR` extra counts a bucket, so that
n-grams seen too rarely to tell weigh little. The log weight is divided by the number of n-grams plus `SMOOTH`, so that
texts of all lengths are held to one weight per n-gram, and a Gumbel number hashed from the id, times `TEMPERATURE`, is
added: the documents of the k largest keys are a sample without replacement with chances proportional to
exp(weight per n-gram / TEMPERATURE). k follows from the labels: the threshold is the `LOSS` quantile of the keys of
good documents that the target was not counted on.

The labelled sample is bounded by `LABELLED` ids; the raw model covers every document. Tasks give at most 2^BITS
counts, so what is shuffled is bounded by the number of tasks, and the models by the number of buckets.

Edge cases: a text without words, null or empty, gives no n-grams to weigh and is never kept; a document with both labels is not good; a
null id shares one Gumbel number with all null ids; repeated rows are judged alike; without good labels every
document with words is kept; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from deedloom.llm.common import blank_words, columns

BITS = 16
PRIOR = 20.0
# n-grams added to every length
SMOOTH = 20
# unit of the Gumbel numbers, in log weight per n-gram
TEMPERATURE = 0.01
LABELLED = 100_000
LOSS = 0.005
SEED = 7
LEAST = -1e300
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbours."""
    words = blank_words(text)
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    pairs = ((h[:-1] * MIX[1]) ^ (h[1:] * MIX[0])) * MIX[2]
    return np.concatenate(((h * MIX[0]) >> shift, pairs >> shift)).astype(np.int64)


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Standard Gumbel numbers hashed from integer ids."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(int(MIX[0]) * (seed + 1) % 2**64)
    for m in MIX[1:]:
        x = (x ^ (x >> np.uint64(31))) * m
    u = ((x ^ (x >> np.uint64(29))) >> np.uint64(11)).astype(float)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def good_ids(labels: DataFrame, bound: int = LABELLED) -> np.ndarray:
    """Ids labelled good only, a hashed sample of about `bound` of them."""
    good = columns(labels, ("doc_id", "long"), ("quality", "int")).where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    share = bound / max(1, good.count())
    if share < 1:
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return np.array(sorted(r[0] for r in good.select("doc_id").collect()), np.int64)


def held(ids: np.ndarray) -> np.ndarray:
    """Which labelled ids calibrate; the others are the target."""
    return gumbel(ids, SEED + 1) > 0.3665  # the median


def ratios(docs: DataFrame, target_ids: np.ndarray, bits: int = BITS, prior: float = PRIOR) -> np.ndarray:
    """log(target / raw) of each bucket, counted over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            chosen = np.isin(batch.column("doc_id").fill_null(-1).to_numpy(), shared.value) & batch.column("doc_id").is_valid().to_numpy(False)
            for at in range(0, batch.num_rows, 256):
                found = [buckets(t, bits) for t in batch.column("text").slice(at, 256).to_pylist()]
                raw += np.bincount(np.concatenate(found), minlength=1 << bits)
                labelled = [f for f, good in zip(found, chosen[at : at + 256]) if good]
                if labelled:
                    target += np.bincount(np.concatenate(labelled), minlength=1 << bits)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    given = columns(docs, ("doc_id", "long"), ("text", "string"))
    rows = given.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(1 << bits)
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))


def key_of(model: np.ndarray, session, seed: int = SEED, temperature: float = TEMPERATURE) -> object:
    """Pandas UDF (doc_id, text) -> words, log weight and key; the key of a text without words is minus infinity."""
    shared = session.sparkContext.broadcast(model)
    bits = len(model).bit_length() - 1

    @F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("key", T.DoubleType())]))
    def keys(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        # buckets of one text at a time: a batch may hold many megabytes of text
        grams, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = buckets(text, bits)
            grams[i], weight[i] = len(found), shared.value[found].sum()
        noise = gumbel(ids.fillna(-1).to_numpy(np.int64), seed)
        key = np.where(grams > 0, weight / (grams + SMOOTH) + temperature * noise, -np.inf)
        return pd.DataFrame({"n_words": (grams + 1) // 2, "log_weight": weight, "key": key})

    return keys


def fit(
    docs: DataFrame, labels: DataFrame, loss: float = LOSS, seed: int = SEED, temperature: float = TEMPERATURE
) -> tuple[object, float]:
    """The key function and the least key that is kept."""
    session, good = docs.sparkSession, good_ids(labels)
    held_out = held(good)
    keys = key_of(ratios(docs, good[~held_out]), session, seed, temperature)
    given = columns(docs, ("doc_id", "long"), ("text", "string"))
    # bounded like the labelled sample
    sample = session.createDataFrame([(int(i),) for i in good[held_out]], "doc_id long")
    scored = given.join(F.broadcast(sample), "doc_id", "left_semi").select(keys("doc_id", "text")["key"].alias("key"))
    least = scored.agg(F.percentile("key", F.lit(loss))).first()[0]
    # without labels, or with empty good documents only, any text with words is kept
    return keys, LEAST if least is None else max(least, LEAST)


def judge(docs: DataFrame, labels: DataFrame, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """One row per document: doc_id, n_words, log_weight, key, kept."""
    keys, least = fit(docs, labels, seed=seed, temperature=temperature)
    scored = columns(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", keys("doc_id", "text").alias("k"))
    return scored.select("doc_id", "k.n_words", "k.log_weight", "k.key", (F.col("k.key") >= F.lit(least)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns: a narrow pass after the fit."""
    keys, least = fit(docs, labels)
    return docs.where(keys(F.col("doc_id").cast("long"), F.col("text").cast("string"))["key"] >= F.lit(least))
