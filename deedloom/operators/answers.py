"""Prompts, stored answers and the records in them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deedloom import fixed
from deedloom.functions import dates as D, jsonx as J, text as T
from deedloom.operators.beside import beside
from deedloom.operators.linkage import answer_confidence
from deedloom.operators.positions import first_per_key, position, running_total
from deedloom.session import arrow_rows, materialize

DOC = ("case_id", "document_id")
# characters of a list that one prompt shows; a longer list makes several prompts
PART_CHARS = 2_000_000


def token_budget(source_type: Column | str) -> Column:
    """Output tokens by source type (FLT-23)."""
    return F.when(F.startswith(T.col(source_type), F.lit(fixed.REGISTER_TYPE)), fixed.REGISTER_TOKENS).otherwise(fixed.DEED_TOKENS)


def scope_source(source_type: Column | str) -> Column:
    return F.when(F.startswith(T.col(source_type), F.lit(fixed.REGISTER_TYPE)), "attest").otherwise("akt")


def resolved_setting(*choices: Column) -> Column:
    """First setting that is not blank (FLT-24)."""
    return F.coalesce(*[F.nullif(T.strip(c), F.lit("")) for c in choices])


def load_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt templates by file name without suffix (SRC-08)."""
    df = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return df.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("source_type"), F.col("value").alias("template")
    )


def with_template(df: DataFrame, templates: DataFrame, source_type: Column, generic: str) -> DataFrame:
    """Template of the source type, else the generic one (SRC-08). Source types are few; two equality joins."""
    t = templates.select(F.col("source_type").alias("_type"), "template")
    g = t.where(F.col("_type") == generic).select(F.col("_type").alias("_other"), F.col("template").alias("_generic"))
    return (
        df.join(t, F.col("_type") == source_type, "left").join(g, F.col("_other") == F.lit(generic), "left")
        .withColumn("template", F.coalesce("template", "_generic")).drop("_type", "_other", "_generic")
    )


def document_prompts(chunks: DataFrame, templates: DataFrame, generic: str = fixed.DEED_TYPE) -> DataFrame:
    """One prompt per document from its chunks, by the template of its type (SRC-08, AGG-16, FLT-23).

    `chunks` has document_type beside its own columns.
    """
    types = chunks.groupBy(*DOC).agg(F.first("document_type").alias("source_type"))
    rows = with_template(chunks_text(chunks).join(types, list(DOC)), templates, F.col("source_type"), generic)
    return rows.select(
        *DOC, F.lit(0).alias("part"), "source_type", F.replace("template", F.lit("{chunks_text}"), F.col("chunks_text")).alias("prompt"),
        token_budget("source_type").alias("max_tokens"), F.lit(None).cast("string").alias("error"),
    ).withColumn("prompt_hash", F.sha2("prompt", 256))


def chunks_text(chunks: DataFrame, keys: tuple[str, ...] = DOC) -> DataFrame:
    """Prompt text of the chosen chunks of each key in order (AGG-16). Selection bounds what enters."""
    block = T.chunk_block("document_id", "page", "chunk_index", "text")
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page", "chunk_index", block.alias("b")))).alias("_l")).select(
        *keys, F.array_join(F.transform("_l", lambda x: x["b"]), "\n\n---\n\n").alias("chunks_text")
    )


def list_parts(rows: DataFrame, key: str, order: str, text: str, out: str, sep: str, limit: int = PART_CHARS) -> DataFrame:
    """Texts of a key joined in order, in parts of about `limit` characters; nothing is left out.

    `order` is an integer column. Sizes are added up block by block, so no long list reaches one task.
    """
    at = running_total(rows.select(key, order, text), [key], order, (F.length(text) + len(sep)).cast("long"), "_at")
    parts = at.withColumn("part", F.floor(F.col("_at") / limit).cast("int"))
    return parts.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l")).select(
        key, "part", F.array_join(F.transform("_l", lambda x: x[text]), sep).alias(out)
    )


def canonical_json(canonicals: DataFrame, limit: int = PART_CHARS) -> DataFrame:
    """Register records of a case as JSON lists a prompt can show, one per part (JSN-07)."""
    item = F.concat(
        F.lit('  {\n    "date_reference": '), J.quoted(F.col("date_reference")), F.lit(',\n    "akt_nr": '),
        J.quoted(F.col("akt_nr")), F.lit(',\n    "title": '), J.quoted(F.col("title")), F.lit("\n  }"),
    )
    rows = canonicals.select("case_id", "ord", item.alias("item"))
    return list_parts(rows, "case_id", "ord", "item", "_items", ",\n", limit).select(
        "case_id", "part", F.concat(F.lit("[\n"), F.col("_items"), F.lit("\n]")).alias("canonical_json")
    )


REPORT_FIELDS = ["servitut_id", "date_reference", "registered_at", "title", "summary", "beneficiary", "disposition_type",
                 "legal_type", "byggeri_markering", "action_note", "applies_to_matrikler", "applies_to_target_matrikel"]


def report_input_json(inputs: DataFrame) -> DataFrame:
    """One JSON object per report record with the twelve fields a report prompt needs (JSN-07)."""
    fields = [F.col(c) if c in inputs.columns else F.lit(None).cast("string").alias(c) for c in REPORT_FIELDS]
    return inputs.select(
        "case_id", "servitut_id", D.sort_date("date_reference").alias("sort_date"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"),
    )


# deeds that meet one copy of their case's register list
DEEDS = 4096
_DEED_MARKS = ("{akt_dok_hint}", "{chunks_text}")


def _case_heads(cases: DataFrame, lists: DataFrame, parcels: DataFrame, template: str) -> DataFrame:
    """case_id, part, head and rest: the template with what a case and a part of its list put in, cut before the first mark of a deed."""
    parcels_json = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("all_matrikler", F.array().cast("array<string>")), J.quoted), ", "), F.lit("]"))
    rows = cases.join(lists, "case_id", "left").join(parcels.select("case_id", "all_matrikler"), "case_id", "left")
    filled = F.replace(F.replace(F.lit(template), F.lit("{canonical_json}"), F.coalesce("canonical_json", F.lit("[]"))), F.lit("{all_matrikler_json}"), parcels_json)
    first = F.least(*[F.nullif(F.instr("_f", m), F.lit(0)) for m in _DEED_MARKS])
    # a few characters more stay with the rest, as what is put in for one mark may complete another
    cut = F.greatest(F.coalesce(first - 1, F.length("_f")) - max(map(len, _DEED_MARKS)), F.lit(0))
    return rows.select("case_id", F.coalesce("part", F.lit(0)).alias("part"), filled.alias("_f")).select(
        "case_id", "part", F.left("_f", cut).alias("head"), F.expr("_f").substr(cut + 1, F.length("_f")).alias("rest")
    )


def _prompt_maker(text: bool) -> Callable:
    """Prompts of each deed, one per part of its case's list; the hash of a head is made once and goes on with the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads, out = None, [], []
        names = ["case_id", "document_id", "part", "chars", "prompt_hash", *(["prompt"] if text else [])]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def send() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return done

        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()  # noqa: E731, B023
            keys = zip(column("case_id"), column("_group"), column("_piece"))
            for key, kind, part, head, rest, document, hint, chunks in zip(keys, *map(column, ("_kind", "part", "head", "rest", "document_id", "hint", "chunks_text"))):
                if key != group:
                    group, heads = key, []
                if kind == 0:
                    heads.append((part, hashlib.sha256(head.encode()), len(head), rest, head if text else None))
                    continue
                known = {}
                for part, begun, n, rest, head in heads:
                    if hint is None or chunks is None:
                        out.append((key[0], document, part, None, None, None)[: len(names)])
                        continue
                    tail = known.get(rest)
                    if tail is None:
                        tail = known[rest] = rest.replace(_DEED_MARKS[0], hint).replace(_DEED_MARKS[1], chunks)
                    whole = begun.copy()
                    whole.update(tail.encode())
                    out.append((key[0], document, part, n + len(tail), whole.hexdigest(), head + tail if text else None)[: len(names)])
                    if len(out) >= (4 if text else 1000):
                        yield send()
        if out:
            yield send()

    return run


def deed_prompts(chunks: DataFrame, canonicals: DataFrame, documents: DataFrame, parcels: DataFrame, template: str, text: bool = True) -> DataFrame:
    """Enrichment prompts of each deed from its selected chunks, one per part of the register list (JSN-09).

    `parcels` has case_id and all_matrikler. The list is part of the prompt by definition; it stays one part
    unless it is longer than a prompt. A case's list is in the prompts of all its deeds, so it is read beside them and hashed once per group;
    without `text` the prompts themselves, which grow with deeds times list, are not made: only their lengths and hashes, written.
    """
    spark = chunks.sparkSession
    # read for the cases and for the deeds, and dear
    texts = materialize(chunks_text(chunks))
    heads = materialize(_case_heads(texts.select("case_id").distinct(), canonical_json(canonicals), parcels, template))
    deeds = texts.join(documents.select(*DOC, "filename"), list(DOC), "left").select(*DOC, F.coalesce("filename", "document_id").alias("hint"), "chunks_text")
    schema = "case_id string, document_id string, part int, chars int, prompt_hash string" + (", prompt string" if text else "")
    made, _ = beside(heads, deeds, "document_id", ["document_id"], _prompt_maker(text), schema, group=DEEDS)
    if not text:
        # texts of deeds and heads of cases are long
        with arrow_rows(spark, 500):
            made = materialize(made)
    rest = ["prompt"] if text else ["chars"]
    return made.select(*DOC, "part", *rest, F.lit(fixed.DEED_TOKENS).alias("max_tokens"), F.lit(None).cast("string").alias("error"), "prompt_hash")


def report_prompts(inputs: DataFrame, cases: DataFrame, template: str, day: str | None = None, limit: int = PART_CHARS) -> DataFrame:
    """Report prompts of each case, one per part of its record list (JSN-09)."""
    # numbering and running totals read their rows twice, so the objects and their order are written out
    objects = materialize(report_input_json(inputs))
    listed = materialize(position(objects, ["case_id"], {"d": F.col("sort_date")}, ["servitut_id"], "ord"))
    lists = list_parts(listed, "case_id", "ord", "json", "_items", ",\n", limit)
    names = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), J.quoted), ", "), F.lit("]"))
    # a case is one row and its parts are many and long: the parts pass by, the cases are what a join holds
    known = materialize(cases.select("case_id", "target_matrikler", "available_matrikler"))
    bare = known.join(objects.select("case_id").distinct(), "case_id", "left_anti")
    rows = lists.join(known, "case_id").unionByName(bare, allowMissingColumns=True)
    whole = F.coalesce(F.concat(F.lit("[\n"), F.col("_items"), F.lit("\n]")), F.lit("[]"))
    prompt = F.lit(template)
    for mark, value in (
        ("{servitutter_json}", whole), ("{evidence_text}", F.lit("")), ("{target_matrikler_json}", names("target_matrikler")),
        ("{all_matrikler_json}", names("available_matrikler")), ("{as_of_date}", F.lit(day or fixed.NO_AS_OF)),
    ):
        prompt = F.replace(prompt, F.lit(mark), value)
    return rows.select(
        "case_id", F.coalesce("part", F.lit(0)).alias("part"), prompt.alias("prompt"), F.lit(fixed.REPORT_TOKENS).alias("max_tokens")
    ).withColumn("prompt_hash", F.sha2("prompt", 256))


def answer(prompts: DataFrame, responder: DataFrame | Callable, schema: str | None = None) -> DataFrame:
    """Answers of prompts: from a table of stored responses, or from a function for mapInPandas (UDF-01).

    A prompt without response becomes a row with an error, never an exception.
    """
    if isinstance(responder, DataFrame):
        stored = responder.select("prompt_hash", "response_text").dropDuplicates(["prompt_hash"])
        out = prompts.join(stored, "prompt_hash", "left")
        missing = F.when(F.col("response_text").isNull(), F.lit("no response"))
        before = F.col("error") if "error" in prompts.columns else F.lit(None).cast("string")
        return out.withColumn("error", F.coalesce(before, missing))
    return prompts.mapInPandas(responder, schema or f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in prompts.schema)}, response_text string")


def records_from_answers(answers: DataFrame, offset: Column | None = None) -> DataFrame:
    """Typed records of each answer in order (JSN-04).

    `answers` has case_id, document_id, source_type and response_text.
    """
    rows = answers.select(*DOC, "source_type", F.posexplode(J.answer_items("response_text")).alias("pos", "item"))
    v = F.col("item")
    ref = J.field(v, "date_reference")
    applies, raw = J.list_field(v, "applies_to_matrikler"), J.list_field(v, "raw_matrikel_references")
    return rows.select(
        *DOC, "pos",
        (F.col("pos") + (offset if offset is not None else F.lit(0))).alias("priority"),
        T.entity_id("srv-", F.col("case_id"), F.col("document_id"), F.col("pos").cast("string")).alias("servitut_id"),
        ref.alias("date_reference"),
        D.registered_at(J.text_field(v, "registered_at"), ref).alias("registered_at"),
        *[J.field(v, c).alias(c) for c in ("akt_nr", "title", "summary", "beneficiary", "disposition_type", "legal_type",
                                           "byggeri_markering", "action_note", "scope_basis")],
        F.coalesce(F.try_variant_get(v, "$.construction_relevance", "boolean"), F.lit(False)).alias("construction_relevance"),
        applies.alias("applies_to_matrikler"),
        F.when(F.size(raw) > 0, raw).otherwise(applies).alias("raw_matrikel_references"),
        F.coalesce(J.field(v, "raw_scope_text"), J.field(v, "scope_basis")).alias("raw_scope_text"),
        F.coalesce(J.field(v, "scope_source"), scope_source("source_type")).alias("scope_source"),
        F.try_variant_get(v, "$.scope_confidence", "double").alias("scope_confidence"),
        answer_confidence(F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
    )


def report_payload(answers: DataFrame, written: bool = True) -> tuple[DataFrame, DataFrame]:
    """Report entries and notes of parsed answers; cases without an object are absent from both (JSN-05, JSN-06).

    Parsing is dear and both results need it, as does what made the answers, so what was parsed is written; who reads one result only, once,
    does without.
    """
    parsed = answers.select("case_id", J.answer_object("response_text").alias("_o"))
    parsed = materialize(parsed) if written else parsed
    notes = parsed.where("_o is not null").select("case_id", F.try_variant_get("_o", "$.notes", "string").alias("notes"))
    # what is no object has no entries; a filter would parse again
    e = F.col("_e")
    text = lambda c: F.try_variant_get(e, f"$.{c}", "string").alias(c)
    rows = parsed.select("case_id", F.posexplode(F.try_variant_get("_o", "$.entries", "array<variant>")).alias("_i", "_e"))
    scope = F.try_variant_get(e, "$.scope", "string")
    entries = rows.select(
        "case_id", (F.col("_i") + 1).alias("answer_nr"),
        *[text(c) for c in ("date_reference", "title", "byggeri_markering", "description", "beneficiary", "disposition",
                            "legal_type", "action", "scope", "scope_detail")],
        J.bool_field(e, "relevant_for_project", F.coalesce(scope == fixed.SCOPE_YES, F.lit(False))).alias("relevant_for_project"),
        F.coalesce(F.try_variant_get(e, "$.servitut_id", "string"), F.lit("")).alias("servitut_id"),
    )
    return entries, notes


def first_evidence(chunks: DataFrame, k: int = 3, n: int = 300) -> DataFrame:
    """First chunks of a document as evidence of its records (GEN-09, SRT-03)."""
    head = first_per_key(chunks.select(*DOC, "chunk_index", "chunk_id", "page", F.left("text", F.lit(n)).alias("text_excerpt")), DOC, ["chunk_index"], k)
    one = F.struct("chunk_index", F.struct("chunk_id", "document_id", "page", "text_excerpt").alias("e"))
    return head.groupBy(*DOC).agg(F.array_sort(F.collect_list(one)).alias("_l")).select(
        *DOC, F.transform("_l", lambda x: x["e"]).alias("evidence")
    )
