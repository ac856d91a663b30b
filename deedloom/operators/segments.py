"""Register extracts: page windows, their candidates, change detection and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from deedloom import fixed
from deedloom.functions import text as T
from deedloom.operators.positions import position
from deedloom.session import materialize

DOC = ("case_id", "document_id")
BLOCK = 512


def page_texts(chunks: DataFrame) -> DataFrame:
    """Text of each page from its chunks in order, with the chunk span (AGG-16, SRT-07)."""
    stripped = T.strip("text")
    grouped = chunks.groupBy(*DOC, "page").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", stripped.alias("t")))).alias("_l"),
        F.min("chunk_index").alias("chunk_start"), F.max("chunk_index").alias("chunk_end"),
    )
    kept = F.filter(F.transform("_l", lambda x: x["t"]), lambda t: t != "")
    return grouped.select(*DOC, "page", "chunk_start", "chunk_end", F.array_join(kept, "\n").alias("text"))


def _page_steps(pages: DataFrame, max_chars: int, max_pages: int, overlap: int) -> DataFrame:
    """For every page: how many pages a segment starting there takes and how far the next start is.

    Looks ahead over at most `max_pages` pages, so blocks of pages with a small halo from the next
    block suffice.
    """
    blk = F.floor(F.col("p") / BLOCK)
    halo = F.when((F.col("p") % BLOCK <= max_pages) & (blk > 0), F.array(blk, blk - 1)).otherwise(F.array(blk))
    rows = pages.select(*DOC, "p", "chars", "starts", F.explode(halo).alias("blk"))
    lists = rows.groupBy(*DOC, "blk").agg(F.array_sort(F.collect_list(F.struct("p", "chars", "starts"))).alias("a"))
    a = F.col("a")
    size = F.size(a)

    def window(i: Column) -> Column:
        start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("pref"), F.lit(False).alias("stop"))
        ahead = F.sequence(i, F.least(i + max_pages, size) - 1)

        def step(s: Column, j: Column) -> Column:
            full = s["stop"] | ((s["k"] > 0) & (s["total"] + F.get(a, j)["chars"] > max_chars))
            next_starts = F.coalesce(F.get(a, j + 1)["starts"], F.lit(False))
            taken = F.struct(
                (s["k"] + 1).alias("k"), (s["total"] + F.get(a, j)["chars"]).cast("bigint").alias("total"),
                F.when(next_starts, s["k"] + 1).otherwise(s["pref"]).alias("pref"), F.lit(False).alias("stop"),
            )
            held = F.struct(s["k"].alias("k"), s["total"].alias("total"), s["pref"].alias("pref"), F.lit(True).alias("stop"))
            return F.when(full, held).otherwise(taken)

        return F.aggregate(ahead, start, step, lambda s: F.when(s["pref"] > 0, s["pref"]).otherwise(s["k"]))

    own = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.floor(F.get(a, i)["p"] / BLOCK) == F.col("blk"))
    steps = F.transform(
        own,
        lambda i: F.struct(F.get(a, i)["p"].alias("p"), i.alias("i"), window(i).alias("n")),
    )
    out = F.transform(
        steps,
        lambda s: F.struct(
            s["p"].alias("p"), s["n"].alias("n"),
            F.when(s["i"] + s["n"] >= size, F.lit(0)).otherwise(F.greatest(F.lit(1), s["n"] - overlap)).alias("step"),
        ),
    )
    return lists.select(*DOC, "blk", out.alias("steps"))


def _through(steps: Column, entry: Column) -> Column:
    """Walk one block from an entry offset: (exit offset into the next block or -1, starts met)."""
    start = F.struct(entry.cast("int").alias("at"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("cnt"))

    def walk(s: Column, x: Column) -> Column:
        here = s["at"] == s["i"]
        moved = F.when(x["step"] == 0, F.lit(-1)).otherwise(s["at"] + x["step"])
        return F.struct(
            F.when(here, moved).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"),
            (s["cnt"] + here.cast("bigint")).alias("cnt"),
        )

    return F.aggregate(
        steps, start, walk,
        lambda s: F.struct(F.when(s["at"] < 0, -1).otherwise(s["at"] - s["i"]).cast("int").alias("exit"), s["cnt"].alias("cnt")),
    )


def _compose(children: Column, entry: Column) -> Column:
    start = F.struct(entry.cast("int").alias("exit"), F.lit(0).cast("bigint").alias("cnt"))

    def step(s: Column, fn: Column) -> Column:
        nxt = F.get(fn, s["exit"])
        return F.when(s["exit"] < 0, s).otherwise(F.struct(nxt["exit"].alias("exit"), (s["cnt"] + nxt["cnt"]).alias("cnt")))

    return F.aggregate(children, start, step)


def _prefixes(children: Column, entry: Column, count: Column) -> Column:
    """State in front of each child: (entry offset or -1, starts met before)."""
    state = "struct<e:int,c:bigint>"
    start = F.struct(entry.cast("int").alias("e"), count.cast("bigint").alias("c"), F.array().cast(f"array<{state}>").alias("out"))

    def step(s: Column, fn: Column) -> Column:
        nxt = F.get(fn, s["e"])
        out = F.concat(s["out"], F.array(F.struct(s["e"].alias("e"), s["c"].alias("c"))))
        return F.struct(
            F.when(s["e"] < 0, -1).otherwise(nxt["exit"]).cast("int").alias("e"),
            F.when(s["e"] < 0, s["c"]).otherwise(s["c"] + nxt["cnt"]).alias("c"), out.alias("out"),
        )

    return F.aggregate(children, start, step, lambda s: s["out"])


def segment_starts(
    pages: DataFrame,
    *,
    max_chars: int = fixed.SEGMENT_MAX_CHARS,
    max_pages: int = fixed.SEGMENT_MAX_PAGES,
    overlap: int = fixed.SEGMENT_OVERLAP_PAGES,
) -> DataFrame:
    """First page, page count and index of every segment (the sequential part of GEN-06).

    `pages` has p (0-based position in the document), chars and starts. Each start depends on the one
    before, so a document is a chain. A block of pages maps the offset at which the chain enters to the
    one at which it leaves; those maps are composed over groups of blocks, then over the document, and
    the found entries are handed back down. No step handles more than BLOCK items of a document at once
    (documents up to BLOCK**3 pages).
    """
    width = max(1, max_pages - overlap)
    entries = F.array(*[F.lit(e) for e in range(width)])
    blocks = materialize(
        _page_steps(pages, max_chars, max_pages, overlap)
        .withColumn("fn", F.transform(entries, lambda e: _through(F.col("steps"), e)))
        .withColumn("grp", F.floor(F.col("blk") / BLOCK))
    )
    gather = lambda df, keys, order: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "fn"))).alias("_l"))
    groups = gather(blocks.select(*DOC, "grp", "blk", "fn"), [*DOC, "grp"], "blk").withColumn("kids", F.transform("_l", lambda x: x["fn"]))
    groups = groups.withColumn("fn", F.transform(entries, lambda e: _compose(F.col("kids"), e)))
    docs = gather(groups.select(*DOC, "grp", "fn"), DOC, "grp").withColumn("kids", F.transform("_l", lambda x: x["fn"]))
    at_group = docs.select(
        *DOC, F.explode(F.arrays_zip(F.transform("_l", lambda x: x["grp"]).alias("grp"), _prefixes(F.col("kids"), F.lit(0), F.lit(0)).alias("s"))).alias("z")
    ).select(*DOC, "z.grp", F.col("z.s.e").alias("e"), F.col("z.s.c").alias("c")).where("e >= 0")
    at_block = groups.join(at_group, [*DOC, "grp"]).select(
        *DOC, F.explode(F.arrays_zip(F.transform("_l", lambda x: x["blk"]).alias("blk"), _prefixes(F.col("kids"), F.col("e"), F.col("c")).alias("s"))).alias("z")
    ).select(*DOC, "z.blk", F.col("z.s.e").alias("e"), F.col("z.s.c").alias("c")).where("e >= 0")
    met = "struct<p:bigint,n:int,idx:bigint>"
    start = F.struct(
        F.col("e").alias("at"), F.lit(0).alias("i"), F.col("c").alias("idx"), F.array().cast(f"array<{met}>").alias("out")
    )

    def walk(s: Column, x: Column) -> Column:
        here = s["at"] == s["i"]
        one = F.array(F.struct(x["p"].cast("bigint").alias("p"), x["n"].alias("n"), s["idx"].alias("idx")))
        moved = F.when(x["step"] == 0, F.lit(-1)).otherwise(s["at"] + x["step"])
        return F.struct(
            F.when(here, moved).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"),
            F.when(here, s["idx"] + 1).otherwise(s["idx"]).alias("idx"),
            F.when(here, F.concat(s["out"], one.cast(f"array<{met}>"))).otherwise(s["out"]).alias("out"),
        )

    found = F.aggregate("steps", start, walk, lambda s: s["out"])
    return blocks.join(at_block, [*DOC, "blk"]).select(*DOC, F.explode(found).alias("_s")).select(
        *DOC, F.col("_s.p").alias("p"), F.col("_s.n").alias("n"), F.col("_s.idx").alias("segment_index")
    )


def build_segments(chunks: DataFrame, **limits: int) -> DataFrame:
    """Register segments with text, hash, heading and candidates (GEN-06, TXT-11 to TXT-17, SRT-04)."""
    texts = materialize(
        page_texts(chunks).withColumns({"chars": F.length("text"), "starts": T.starts_new_entry("text")})
    )
    light = position(texts.select(*DOC, "page", "chars", "starts"), list(DOC), {"b": F.floor(F.col("page") / BLOCK)}, ["page"], "_nr")
    light = materialize(light.withColumn("p", F.col("_nr") - 1).drop("_nr"))
    starts = segment_starts(light.select(*DOC, "p", "chars", "starts"), **limits)
    wanted = starts.select(*DOC, "segment_index", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("p"))
    rows = wanted.join(light.select(*DOC, "p", "page"), [*DOC, "p"]).join(
        texts.select(*DOC, "page", "text", "chunk_start", "chunk_end"), [*DOC, "page"]
    )
    block = F.concat(F.lit("[Side "), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    grouped = rows.groupBy(*DOC, "segment_index").agg(
        F.array_sort(F.collect_list(F.struct("page", block.alias("t")))).alias("_l"),
        F.min("chunk_start").alias("chunk_start_index"), F.max("chunk_end").alias("chunk_end_index"),
    )
    named = grouped.select(
        *DOC,
        F.format_string("%s-segment-%04d", F.col("document_id"), F.col("segment_index")).alias("segment_id"),
        "segment_index", F.transform("_l", lambda x: x["page"]).alias("page_numbers"),
        "chunk_start_index", "chunk_end_index", F.array_join(F.transform("_l", lambda x: x["t"]), "\n\n").alias("text"),
    )
    return named.withColumns(
        {
            "page_start": F.get("page_numbers", F.lit(0)),
            "page_end": F.get("page_numbers", F.size("page_numbers") - 1),
            "text_hash": T.text_hash("text"),
            "heading": T.heading("text"),
            "raw_scope_text": T.scope_line("text"),
            "candidate_date_references": T.first_matches("text", fixed.DATE_REFERENCE),
            "candidate_archive_numbers": T.first_matches("text", fixed.ARCHIVE_NUMBER),
            "raw_matrikel_references": T.parcel_refs("text"),
        }
    )


def segment_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of each segment by page (JN-08)."""
    pages = segments.select(*DOC, "segment_id", "segment_index", F.explode("page_numbers").alias("page"))
    return pages.join(chunks, [*DOC, "page"])


def source_signature(chunks: DataFrame) -> DataFrame:
    """Fingerprint of a document's chunks, changing exactly when page, index or text of one changes (AGG-17).

    Chunks are hashed one by one, then in blocks in order, then the blocks: a document is never joined
    into one text. Only equality of two signatures has meaning.
    """
    one = F.sha2(F.concat_ws(":", F.col("page").cast("string"), F.col("chunk_index").cast("string"), F.col("text")), 256)
    rows = chunks.select(*DOC, F.floor(F.col("chunk_index") / BLOCK).alias("b"), "page", "chunk_index", one.alias("h"))
    ordered = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "h"))), lambda x: x["h"]), "\n")
    blocks = rows.groupBy(*DOC, "b").agg(F.sha2(ordered("page", "chunk_index"), 256).alias("h"))
    tops = blocks.groupBy(*DOC, F.floor(F.col("b") / BLOCK).alias("bb")).agg(F.sha2(ordered("b"), 256).alias("h"))
    return tops.groupBy(*DOC).agg(F.sha2(ordered("bb"), 256).alias("source_signature"))


def reusable_state(signatures: DataFrame, state: DataFrame, version: int = fixed.SEGMENT_STATE_VERSION) -> DataFrame:
    """Documents with a flag whether their stored segments still hold (FLT-16).

    `state` has document keys, version, source_signature and segment_count.
    """
    s = state.select(*DOC, "version", F.col("source_signature").alias("_sig"), "segment_count")
    ok = (F.col("version") == version) & (F.col("_sig") == F.col("source_signature")) & (F.col("segment_count") > 0)
    return signatures.join(s, list(DOC), "left").select(*DOC, "source_signature", F.coalesce(ok, F.lit(False)).alias("reused"))


def segments_to_extract(state: DataFrame, budget: int = fixed.REGISTER_TOKENS) -> DataFrame:
    """Segments still open: not completed, completed empty, or completed under a smaller budget (FLT-15)."""
    raised = F.coalesce(F.col("extraction_max_tokens") < budget, F.lit(False))
    done = (F.col("extraction_status") == "completed") & (F.col("record_count") > 0) & ~raised
    reason = (
        F.when(F.col("extraction_status") != "completed", "pending").when(raised, "token-budget hævet").otherwise("0 servitutter tidligere")
    )
    return state.where(~F.coalesce(done, F.lit(False))).withColumn("reason", reason)


def completeness(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed segments per document, and the cases any failure rejects (AGG-18)."""
    docs = state.groupBy(*DOC).agg(
        F.count_if(F.col("extraction_status") == "failed").alias("failed_segments"), F.count(F.lit(1)).alias("total_segments")
    )
    rejected = docs.where("failed_segments > 0").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("incomplete_documents"), F.sum("failed_segments").alias("failed_segments")
    )
    return docs, rejected


def stale_artifacts(files: DataFrame, needs: Sequence[tuple[str, Sequence[str]]], force: bool = False) -> DataFrame:
    """Artifacts that are missing or older than something they depend on (FLT-17).

    `files` has document keys, kind and modified_at; `needs` lists (artifact, its dependencies).
    """
    by_kind = files.groupBy(*DOC).agg(
        *[F.max(F.when(F.col("kind") == k, F.col("modified_at"))).alias(f"at_{k}")
          for k in sorted({a for a, _ in needs} | {d for _, ds in needs for d in ds})]
    )
    flags = []
    for artifact, deps in needs:
        fresh = F.col(f"at_{artifact}").isNotNull()
        for d in deps:
            fresh = fresh & F.coalesce(F.col(f"at_{artifact}") >= F.col(f"at_{d}"), F.lit(False))
        flags.append(F.struct(F.lit(artifact).alias("artifact"), (F.lit(force) | ~fresh).alias("stale")))
    return by_kind.select(*DOC, F.explode(F.array(*flags)).alias("_f")).select(*DOC, "_f.artifact", "_f.stale")
