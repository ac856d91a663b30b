"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows (10 consecutive words, or all words of a shorter item) are the query set. A task gathers
documents into shards of about `SHARD_TOKENS` words. Words are numbered by the benchmark's vocabulary; others can be
in no window, so they only separate, and stretches too short for the shortest window are left out. The shard's
sequence is indexed; all windows are searched backward at once through wavelet ranks, occurrences are located by
sampled suffix positions, and covered words are merged to removal spans of each document.

The benchmark is read in blocks of about `BLOCK_BYTES`, whatever its size, each broadcast for one more narrow pass
that carries the spans found so far: no row of a document is shuffled, and nothing depends on how often a passage
repeats.

Edge cases: a null or empty text has no words and is clean; a null or empty item has no window; an item without id
marks words but is no listed item; repeated rows of documents are judged alike, repeated items count once; a document
longer than a shard is a shard of its own; an empty table gives an empty result, an empty benchmark leaves all clean;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deedloom.llm.common import columns, item_words
from deedloom.llm.fm_index import FMIndex

WINDOW = 10
SHARD_TOKENS = 2_000_000
BLOCK_BYTES = 16 << 20
SEPARATOR = 1


def windows(items: list[tuple[int | None, str | None]]) -> tuple[dict[bytes, int], dict[int, np.ndarray], dict[int, list[list]]]:
    """Vocabulary (word -> number from 2), and by length the distinct windows and the item ids of each."""
    vocabulary: dict[bytes, int] = {}
    owners: dict[int, dict[tuple, set]] = {}
    for item_id, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 2) for w in item_words(text)]
        length = min(WINDOW, len(numbers))
        for at in range(len(numbers) - length + 1 if length else 0):
            ids = owners.setdefault(length, {}).setdefault(tuple(numbers[at : at + length]), set())
            if item_id is not None:
                ids.add(item_id)
    return (
        vocabulary,
        {n: np.array(list(w), np.int64) for n, w in owners.items()},
        {n: [sorted(ids) for ids in w.values()] for n, w in owners.items()},
    )


def search(texts: list, vocabulary: dict, phrases: dict, owners: dict) -> tuple[list[int], list[list], list[set]]:
    """Words, hit words (sorted numbers) and items of each text of one shard."""
    counts, runs, starts, docs = [], [], [], []
    least = min(phrases, default=0)
    hits: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for d, text in enumerate(texts):
        words = item_words(text)
        counts.append(len(words))
        if not least or len(words) < least:
            continue
        numbers = np.fromiter((vocabulary.get(w, 0) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], numbers > 0, [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                runs.append(numbers[a:b])
                starts.append(a)
                docs.append(d)
    if not runs:
        return counts, hits, items
    lengths = np.array([len(r) + 1 for r in runs])
    offsets = np.cumsum(lengths) - lengths
    joined = np.concatenate([x for r in runs for x in (r, [SEPARATOR])])
    index = FMIndex(joined)
    for length, table in phrases.items():
        which, position = index.find(table)
        run = np.searchsorted(offsets, position, side="right") - 1
        first = np.array(starts)[run] + position - offsets[run]
        for w, r, at in zip(which.tolist(), run.tolist(), first.tolist()):
            hits[docs[r]].append((at, at + length))
            items[docs[r]].update(owners[length][w])
    return counts, hits, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word intervals, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in shards bounded by bytes of text (some five bytes a word)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        text = batch.column("text")
        for at in range(0, batch.num_rows, 512):
            held.append(batch.slice(at, 512))
            size += text.slice(at, 512).nbytes
            if size >= 5 * SHARD_TOKENS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def blocks_of(benchmark: DataFrame) -> Iterator:
    """Broadcast query sets of about BLOCK_BYTES of item text each, at least one."""
    items = columns(benchmark, ("item_id", "long"), ("text", "string"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(windows([tuple(r) for r in part.collect()]))


def _search_pass(docs: DataFrame, shared, out: list[str]) -> DataFrame:
    """Adds what one block of the benchmark finds and gives on the columns `out`."""
    types = {"n_words": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            counts, hits, items = search(shard["text"].to_pylist(), *shared.value)
            found = {
                "n_words": counts,
                "spans": [merged([*map(tuple, old), *new]) for old, new in zip(shard["spans"].to_pylist(), hits)],
                "items": [sorted({*old, *new}) for old, new in zip(shard["items"].to_pylist(), items)],
            }
            for name, values in found.items():
                shard = shard.set_column(shard.schema.get_field_index(name), name, pa.array(values, types[name]))
            yield from shard.select(out).to_batches()

    return docs.mapInArrow(run, docs.select(*out).schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, spans [first word, word after the last] to remove, items."""
    none = {"n_words": "0L", "spans": "cast(array() as array<array<bigint>>)", "items": "cast(array() as array<bigint>)"}
    now = columns(docs, ("doc_id", "long"), ("text", "string")).withColumns({k: F.expr(v) for k, v in none.items()})
    blocks = list(blocks_of(benchmark))
    for block in blocks[:-1]:
        now = _search_pass(now, block, now.columns)
    return _search_pass(now, blocks[-1], ["doc_id", *none])


def report(found: DataFrame) -> DataFrame:
    """Digest columns of `contamination`."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.get(x, F.lit(1)) - F.get(x, F.lit(0)))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _clean_pass(docs: DataFrame, shared) -> DataFrame:
    """Keeps the rows in which one block of the benchmark finds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            hits = search(shard["text"].to_pylist(), *shared.value)[1]
            yield from shard.filter(pa.array([not h for h in hits], pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage, with their own columns: narrow passes, no join."""
    for block in blocks_of(benchmark):
        docs = _clean_pass(docs, block)
    return docs
