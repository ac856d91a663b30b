"""Evidence: chunks that name a record, best chunks by shared words, lineage to the page."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deedloom.functions import text as T
from deedloom.operators.beside import beside
from deedloom.operators.positions import first_per_key
from deedloom.session import materialize

DOC = ("case_id", "document_id")
# rarest words of a record whose posting lists are read first
PROBES = 2


def evidence_pick(items: DataFrame, candidates: DataFrame, k: int = 3, n: int = 300, key: str = "ord", out: str = "item_ord") -> DataFrame:
    """For each item the first k candidate chunks of its document that name its date or archive id, else the first k (JN-16).

    `key` names an item inside its case and becomes the column `out`. Candidates are the selected chunks of a document, at most a dozen, so the join fans out by that much only.
    """
    needles = F.array_compact(
        F.array(F.nullif(T.archive_key("date_reference"), F.lit("")), F.nullif(T.archive_key("akt_nr"), F.lit("")))
    )
    asked = items.select("case_id", F.col(key).alias(out), "document_id", needles.alias("_needles"))
    chunks = candidates.select(*DOC, "chunk_index", "chunk_id", "page", F.left("text", F.lit(n)).alias("text_excerpt"), T.archive_key("text").alias("_t"))
    pairs = asked.join(chunks, list(DOC)).withColumn("_hit", F.exists("_needles", lambda x: F.contains(F.col("_t"), x)))
    per_item = pairs.groupBy("case_id", out).agg(F.bool_or("_hit").alias("_any"))
    usable = pairs.drop("_t", "_needles").join(per_item, ["case_id", out]).where("_hit or not _any")
    return first_per_key(usable, ["case_id", out], ["chunk_index"], k).select(
        "case_id", out, *DOC[1:], "chunk_index", "chunk_id", "page", "text_excerpt", F.col("_any").alias("named")
    )


class _Asked:
    """Records (by their words) that ask a group of chunks, and the best chunks of each so far."""

    def __init__(self, rows: list[tuple[str, int, str]], k: int):
        self.rows, self.k = rows, k
        of: dict[str, list[int]] = {}
        for i, (_, _, words) in enumerate(rows):
            for word in words.split(" "):
                of.setdefault(word, []).append(i)
        self.lists = [np.array(x) for x in of.values()]
        self.starts: dict[str, list] = {}
        for i, word in enumerate(of):
            self.starts.setdefault(word[:3], []).append((word, i))
        self.known: dict[str, list] = {}
        self.best: list[list] = [[] for _ in rows]
        self.least = np.zeros(len(rows), np.int64)

    def inside(self, token: str) -> list:
        """Words asked that lie in a word of a text."""
        found = self.known.get(token)
        if found is None:
            found = [i for at in range(len(token) - 2) for word, i in self.starts.get(token[at : at + 3], ()) if token.startswith(word, at)]
            if len(self.known) < _TOKENS_KEPT:
                self.known[token] = found
        return found

    def meet(self, place: tuple, words: set) -> None:
        """A chunk that holds these words; chunks come in order, so only a higher count moves another one back."""
        if not words:
            return
        counts = np.bincount(np.concatenate([self.lists[w] for w in words]), minlength=len(self.rows))
        for q in np.flatnonzero(counts > self.least).tolist():
            best, m = self.best[q], int(counts[q])
            best.insert(bisect_right(best, -m, key=lambda x: x[0]), (-m, *place))
            if len(best) >= self.k:
                del best[self.k :]
                self.least[q] = -best[-1][0]


# words of a group's texts whose asked words are remembered
_TOKENS_KEPT = 1 << 18


def _best_of_groups(k: int) -> Callable:
    """The k best chunks of a group of chunks for each record that asks it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, asked, place, words = None, [], None, None, set()

        def send() -> Iterator[pa.RecordBatch]:
            if asked is not None:
                asked.meet(place, words)
                out = [(group[0], wkey, n, *at, -m) for (wkey, n, _), best in zip(rows, asked.best) for m, *at in best]
                if out:
                    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
                    yield from pa.Table.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["case_id", "wkey", "n", "document_id", "chunk_index", "m"]
                    ).to_batches(10_000)

        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).tolist()  # noqa: E731, B023
            keys = zip(column("case_id"), column("_group"), column("_piece"))
            entries = zip(column("wkey"), batch.column("n").to_pylist(), column("words"))
            texts = zip(column("document_id"), batch.column("chunk_index").to_pylist(), column("tokens"))
            for key, kind, entry, (document, at, tokens) in zip(keys, column("_kind"), entries, texts):
                if key != group:
                    yield from send()
                    group, rows, asked, place, words = key, [], None, None, set()
                if kind == 0:
                    rows.append(entry)
                elif rows:
                    asked = asked or _Asked(rows, k)
                    if (document, at) != place:
                        # rows of one chunk stand together and count as one
                        asked.meet(place, words)
                        place, words = (document, at), set()
                    for token in tokens.split(" ") if tokens else ():
                        words.update(asked.inside(token))
        yield from send()

    return run


def keyword_top_k(records: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Best chunks per record by the share of its words they contain (JN-17, SRT-02, TXT-28, TXT-29).

    The pool is the source document, or the whole case when that has no chunks. Records with the same words are scored once.

    Records that ask their whole case are read beside its chunks (`beside`): a word is contained in a text exactly when it is contained
    in one of the text's words, a chunk adds one to the records of each word it holds, and a group of chunks keeps the k best of
    each record. No list of a word's chunks is made. The work is chunks times the records that share a word with them.

    In a document the few words asked are looked up in the text. The words of a record that occur there are put in order, rarest first.
    A chunk that is first found through the r-th of p words holds at most p - r + 1 of them. So the posting lists of the `PROBES` rarest
    words give candidates and with them a k-th best count, and of the other lists only those are read whose bound reaches it; where
    the bound only equals it, only chunks that come before the k-th. Common words are mostly never looked up.
    """
    words = T.query_words(F.col("title"), F.col("summary"), F.col("beneficiary"))
    docs = chunks.select(*DOC).distinct().withColumn("_has", F.lit(True))
    r = records.select("case_id", "servitut_id", F.col("source_document").alias("document_id"), F.array_sort(words).alias("words"))
    r = r.where(F.size("words") > 0).join(docs, list(DOC), "left").withColumn(
        "pool", F.when(F.col("_has"), F.concat(F.lit("d:"), F.col("document_id"))).otherwise("c:")
    )
    r = r.withColumn("wkey", F.sha2(F.array_join("words", " "), 256)).drop("_has")
    asked = r.select("case_id", "pool", "wkey", "words").distinct()
    chunk = ["case_id", "pool", "document_id", "chunk_index"]
    # a document's chunks meet the words asked of it once, with their text; nothing of its own words is dealt out
    own_words = asked.where("pool <> 'c:'").groupBy("case_id", "pool").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    own = chunks.select("case_id", F.concat(F.lit("d:"), F.col("document_id")).alias("pool"), *DOC[1:], "chunk_index", F.lower("text").alias("_t"))
    postings = materialize(
        own.join(own_words, ["case_id", "pool"]).select(*chunk, F.explode(F.filter("words", lambda w: F.contains(F.col("_t"), w))).alias("word"))
    )
    lists = postings.groupBy(*chunk).agg(F.collect_list("word").alias("have"))
    lengths = postings.groupBy("case_id", "pool", "word").agg(F.count(F.lit(1)).alias("df"))
    record = ["case_id", "pool", "wkey"]
    ordered = (
        asked.where("pool <> 'c:'").select(*record, F.size("words").alias("n"), F.explode("words").alias("word")).join(lengths, ["case_id", "pool", "word"])
        .groupBy(*record, "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("_l"))
        .select(*record, "n", F.transform("_l", lambda x: x["word"]).alias("present"))
    )
    every = materialize(ordered.unionByName(asked.where("pool = 'c:'").select(*record, F.size("words").alias("n"), F.col("words").alias("present"))))
    ordered, wide = every.where("pool <> 'c:'"), every.where("pool = 'c:'")

    def counted(found: DataFrame) -> DataFrame:
        """How many of the record's words each candidate chunk holds."""
        return found.join(lists, chunk).select(*record, "n", *chunk[2:], F.size(F.array_intersect("present", "have")).alias("m"))

    lookup = lambda rows: rows.join(postings, ["case_id", "pool", "word"])
    rare = lookup(ordered.select("*", F.explode(F.slice("present", 1, PROBES)).alias("word"))).select(*record, "n", "present", *chunk[2:]).distinct()
    tokens = F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))), " ")
    texts = chunks.join(wide.select("case_id").distinct(), "case_id", "left_semi").select(*DOC, "chunk_index", tokens.alias("tokens"))
    index = wide.select("case_id", "wkey", "n", F.array_join("present", " ").alias("words"))
    schema = "case_id string, wkey string, n int, document_id string, chunk_index int, m int"
    of_case, _ = beside(index, texts, "document_id", ["document_id", "chunk_index"], _best_of_groups(k), schema)
    candidates = counted(rare).unionByName(of_case.withColumn("pool", F.lit("c:")))
    best = [F.desc("m"), "document_id", "chunk_index"]
    first = materialize(candidates.withColumn("place", F.row_number().over(Window.partitionBy(*record).orderBy(*best))).where(F.col("place") <= k))
    kth = first.where(F.col("place") == k).select(*record, F.col("m").alias("_m"), F.struct("document_id", "chunk_index").alias("_at"))
    bound = F.size("present") - F.col("_i")
    rest = (
        ordered.join(kth, record, "left").select("*", F.posexplode("present").alias("_i", "word"))
        .where((F.col("_i") >= PROBES) & (bound >= F.coalesce("_m", F.lit(1)))).withColumn("_bound", bound).drop("_i")
    )
    before = F.struct("document_id", "chunk_index") < F.col("_at")
    later = lookup(rest).where(F.col("_m").isNull() | (F.col("_bound") > F.col("_m")) | before).select(*record, "n", "present", *chunk[2:]).distinct()
    hits = first.drop("place").unionByName(counted(later)).distinct()
    scored = hits.withColumn("score", F.col("m") / F.col("n"))
    w = Window.partitionBy("case_id", "pool", "wkey").orderBy(F.desc("score"), "document_id", "chunk_index")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select("case_id", "servitut_id", "pool", "wkey").join(best, ["case_id", "pool", "wkey"]).select(
        "case_id", "servitut_id", "document_id", "chunk_index", F.round("score", 6).alias("score"), "rank"
    )


def trace_evidence(records: DataFrame, chunks: DataFrame, pages: DataFrame, n: int = 1500) -> DataFrame:
    """Record to evidence to chunk to page (JN-18)."""
    ev = records.select("case_id", "servitut_id", F.posexplode("evidence").alias("pos", "e")).select(
        "case_id", "servitut_id", "pos", "e.chunk_id", "e.document_id", "e.page", "e.text_excerpt"
    )
    c = chunks.select(*DOC, "chunk_id", F.col("text").alias("chunk_text"))
    p = pages.select(*DOC, F.col("page_number").alias("page"), F.left("text", F.lit(n)).alias("page_text"), F.col("confidence").alias("page_confidence"))
    return ev.join(c, [*DOC, "chunk_id"], "left").join(p, [*DOC, "page"], "left")
