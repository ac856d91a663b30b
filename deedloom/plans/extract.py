"""From chunks to records in two passes with stored answers between them.

Pass one reads register extracts: segments, prompts, answers, merged register records. Pass two reads
deeds: scored and selected chunks, prompts, answers, linkage to the register records. Cases without a
register extract fall back to their deeds alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from deedloom import fixed
from deedloom.functions import text as T
from deedloom.operators import answers as A, folds, linkage, retrieve, segments as G, signals
from deedloom.operators.positions import first_per_key, position
from deedloom.session import materialize

DOC = ("case_id", "document_id")
# prompts -> prompts with response_text and error, such as functools.partial(answers.answer, responder=stored)
Ask = Callable[[DataFrame], DataFrame]


def typed_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with the type and file name of their document; unknown documents count as deeds (JN-02, FLT-02)."""
    d = documents.select(*DOC, "document_type", "filename")
    return chunks.join(d, list(DOC), "left").withColumn("document_type", F.coalesce("document_type", F.lit(fixed.DEED_TYPE)))


def register_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of known register extracts only (FLT-03)."""
    r = documents.where(F.col("document_type") == fixed.REGISTER_TYPE).select(*DOC)
    return chunks.join(r, list(DOC), "left_semi")


def prescreen(chunks: DataFrame) -> DataFrame:
    """Chunks with at least one keyword (FLT-01); the filter comes before anything expensive."""
    return chunks.where(T.has_keywords("text"))


def segment_prompts(segments: DataFrame, chunks: DataFrame, templates: DataFrame) -> DataFrame:
    """One prompt per register segment, by the template of register extracts or the generic one."""
    rows = G.segment_chunks(segments.select(*DOC, "segment_id", "segment_index", "page_numbers"), chunks)
    texts = A.with_template(A.chunks_text(rows, ("case_id", "document_id", "segment_id")), templates, F.lit(fixed.REGISTER_TYPE), fixed.DEED_TYPE)
    prompt = F.replace("template", F.lit("{chunks_text}"), F.col("chunks_text"))
    return texts.select(*DOC, "segment_id", prompt.alias("prompt"), F.lit(fixed.REGISTER_TOKENS).alias("max_tokens")).withColumn(
        "prompt_hash", F.sha2("prompt", 256)
    )


def canonical_from_answers(
    segments: DataFrame, chunks: DataFrame, answers: DataFrame, documents: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Register records merged per document and again per case, their evidence, and the cases rejected as incomplete.

    `answers` has document keys, segment_id, response_text and error; `documents` has pos. One failed
    segment rejects its case.
    """
    seg = segments.select(*DOC, "segment_id", "segment_index", "page_numbers")
    answered = seg.join(answers.select(*DOC, "segment_id", "response_text", "error"), [*DOC, "segment_id"], "left")
    state = answered.select(*DOC, F.when(F.col("response_text").isNull(), "failed").otherwise("completed").alias("extraction_status"))
    _, rejected = G.completeness(state)
    good = answered.join(rejected.select("case_id"), "case_id", "left_anti").withColumn("source_type", F.lit(fixed.REGISTER_TYPE))
    rows = A.records_from_answers(
        good.select("case_id", F.concat_ws("\x01", "document_id", F.col("segment_index").cast("string")).alias("document_id"), "source_type", "response_text")
    )
    part = lambda i: F.split_part("document_id", F.lit("\x01"), F.lit(i))
    keyed = rows.withColumns({"segment_index": part(2).cast("bigint"), "source_document": part(1), "document_id": part(1)})
    records = materialize(position(keyed.drop("priority"), list(DOC), {"s": F.col("segment_index")}, ["pos"], "ord").drop("pos"))
    listed = G.segment_chunks(seg, chunks).select(*DOC, "segment_index", "page", "chunk_index", "chunk_id", F.left("text", F.lit(300)).alias("text_excerpt"))
    head = first_per_key(listed, [*DOC, "segment_index"], ["page", "chunk_index"], 3)
    nth = F.row_number().over(Window.partitionBy(*DOC, "segment_index").orderBy("page", "chunk_index"))
    head = head.withColumn("pos", nth)  # three rows per segment at most
    evidence = materialize(
        records.select(*DOC, "segment_index", "ord").join(head, [*DOC, "segment_index"]).select(
            *DOC, "ord", "pos", "chunk_id", "page", "text_excerpt"
        )
    )
    per_doc, ev_doc = folds.merge_register(records, evidence, list(DOC))
    placed = position(
        per_doc.drop("members", "first_page").join(documents.select(*DOC, F.col("pos").alias("_p")), list(DOC)),
        ["case_id"], {"p": F.col("_p"), "n": F.floor(F.col("priority") / 4096)}, ["priority"], "ord2",
    )
    placed = materialize(placed.drop("_p", "priority"))
    link = placed.select("case_id", "document_id", "founder", F.col("ord2").alias("_o"))
    ev2 = (
        ev_doc.withColumn("_src", F.col("document_id")).join(link, ["case_id", "document_id", "founder"])
        .select("case_id", F.col("_o").alias("ord"), (F.col("ord") * 4 + F.col("pos")).alias("pos"), "chunk_id", F.col("_src").alias("document_id"), "page", "text_excerpt")
    )
    second = placed.drop("founder", "document_id").withColumnRenamed("ord2", "ord")
    merged, ev_case = folds.merge_register(second, materialize(ev2), ["case_id"])
    named = merged.withColumn("servitut_id", T.entity_id("srv-", F.col("case_id"), F.col("source_document"), F.col("founder").cast("string")))
    named = materialize(named.withColumnRenamed("priority", "ord"))
    kept = ev_case.join(named.select("case_id", "founder", "servitut_id"), ["case_id", "founder"])
    numbered = position(kept, ["case_id", "servitut_id"], {"o": F.floor(F.col("ord") / 4096)}, ["ord", F.col("pos")], "nr")
    rows = numbered.select("case_id", "servitut_id", (F.col("nr") - 1).alias("pos"), "chunk_id", "document_id", "page", "text_excerpt")
    return named, rows, rejected


def items_from_answers(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """Records read from deeds in arrival order, ready for linkage: by document, prompt part and place in the answer.

    `answers` has document keys, part and response_text; `documents` has pos.
    """
    part = lambda i: F.split_part("document_id", F.lit("\x01"), F.lit(i))
    joined = F.concat_ws("\x01", "document_id", F.col("part").cast("string"))
    rows = A.records_from_answers(
        answers.select("case_id", joined.alias("document_id"), F.lit(fixed.DEED_TYPE).alias("source_type"), "response_text")
    ).withColumns({"part": part(2).cast("int"), "document_id": part(1)})
    own = T.entity_id("srv-", F.col("case_id"), F.col("document_id"), F.col("part").cast("string"), F.col("pos").cast("string"))
    listed = rows.withColumn("servitut_id", own).join(documents.select(*DOC, F.col("pos").alias("_p")), list(DOC), "left")
    return position(listed.drop("priority"), ["case_id"], {"d": F.col("_p"), "i": F.col("document_id")}, ["part", "pos"], "ord").drop("pos", "part", "_p")


def second_pass(
    chunks: DataFrame, canonicals: DataFrame, register_evidence: DataFrame, documents: DataFrame, parcels: DataFrame, ask: Ask,
    templates: DataFrame, enrich_template: str, texts: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Final records of every case and their evidence rows, from chunks over prompts and answers.

    Deeds of cases with register records: selected chunks, enrichment prompts, answers, linkage (JN-16, SET-01, SET-08). Deeds of
    other cases: keyword chunks, prompts by document type, answers, de-duplication (FLT-01, SRC-08, AGG-20).
    `register_evidence` has case_id, servitut_id, pos, chunk_id, document_id, page, text_excerpt. Evidence stays a
    child table keyed by (case_id, servitut_id): the register's rows first, then the deed's, repeats kept. Without `texts` the prompts
    of deeds that `ask` gets have their hash and no text.
    """
    have = canonicals.select("case_id").distinct()
    typed = materialize(typed_chunks(chunks, documents).where(F.col("document_type") == fixed.DEED_TYPE).drop("filename"))
    of_register = typed.join(have, "case_id", "left_semi")
    chosen = signals.score_and_select(of_register, canonicals).where("selected").select(*signals.CHUNK)
    candidates = materialize(of_register.join(chosen, list(signals.CHUNK), "left_semi"))
    answered = ask(A.deed_prompts(candidates, canonicals, documents, parcels, enrich_template, texts))
    items = materialize(items_from_answers(answered, documents))
    resolved = materialize(linkage.resolve_keys(items, canonicals))
    linked = linkage.enrichment_links(canonicals, resolved)
    picked = retrieve.evidence_pick(linked, candidates, key="servitut_id", out="servitut_id")
    enriched = linkage.enrich_canonicals(canonicals, resolved)

    screened = materialize(prescreen(typed.join(have, "case_id", "left_anti")))
    alone = materialize(folds.dedup_deeds(materialize(items_from_answers(ask(A.document_prompts(screened, templates)), documents))))
    heads = first_per_key(screened.select(*DOC, "chunk_index", "chunk_id", "page", F.left("text", F.lit(300)).alias("text_excerpt")), DOC, ["chunk_index"], 3)
    own = alone.select("case_id", "servitut_id", "document_id").join(heads, list(DOC))

    records = enriched.unionByName(
        alone.drop("centre", "group_size").withColumnRenamed("document_id", "source_document").withColumn("attest_confirmed", F.lit(True)),
        allowMissingColumns=True,
    )
    # three rows of a record at most
    nth = F.row_number().over(Window.partitionBy("case_id", "servitut_id").orderBy("chunk_index")) - 1
    deed = picked.drop("named").unionByName(own).withColumn("pos", nth.cast("long"))
    cols = ["case_id", "servitut_id", F.col("pos").cast("long").alias("pos"), "chunk_id", "document_id", "page", "text_excerpt"]
    evidence = register_evidence.select(F.lit("register").alias("origin"), *cols).unionByName(deed.select(F.lit("deed").alias("origin"), *cols))
    return records, evidence


def first_pass(chunks: DataFrame, documents: DataFrame, ask: Ask, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Register records, their evidence and the rejected cases, from the chunks of register extracts."""
    mine = materialize(register_chunks(chunks, documents))
    seg = materialize(G.build_segments(mine))
    answered = materialize(ask(segment_prompts(seg, mine, templates)))
    return canonical_from_answers(seg, mine, answered, documents)


def extract_document_records(
    chunks: DataFrame, documents: DataFrame, parcels: DataFrame, ask: Ask, templates: DataFrame, enrich_template: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, evidence and rejected cases of both passes. Cases with a failed register segment give no records."""
    canonicals, evidence, rejected = first_pass(chunks, documents, ask, templates)
    good = chunks.join(rejected.select("case_id").distinct(), "case_id", "left_anti")
    records, every = second_pass(good, canonicals, evidence, documents, parcels, ask, templates, enrich_template)
    return records, every, rejected


def ingest_documents(audit: DataFrame) -> DataFrame:
    """Document rows of the imported files, with an id that a retry repeats (SNK-04)."""
    name = F.lower("name")
    by_name = F.lit(False)
    for w in fixed.REGISTER_FILENAME_MARKERS:
        by_name = by_name | F.contains(name, F.lit(w))
    return audit.where("outcome = 'imported'").select(
        "case_id", T.entity_id("doc-", F.col("case_id"), F.col("content_hash")).alias("document_id"), F.col("name").alias("filename"),
        F.when(by_name, fixed.REGISTER_TYPE).otherwise(fixed.DEED_TYPE).alias("document_type"), F.lit("pending").alias("parse_status"),
    )
