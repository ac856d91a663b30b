"""Report table: as-of filter, scope, de-duplication, ordering, fallback texts, numbering, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deedloom import fixed
from deedloom.functions import dates as D, parcels as P, text as T
from deedloom.operators import answers as A
from deedloom.operators.positions import first_per_key, numbered, position
from deedloom.session import materialize

# characters of a deed that an entry shows
RAW_CHARS = 500


def as_of(records: DataFrame, day: str | None) -> DataFrame:
    """Undated records and those registered on or before the day (FLT-04)."""
    if day is None:
        return records
    reg = F.col("registered_at")
    return records.where(reg.isNull() | (reg <= F.lit(day).cast("date")))


def annotate_scope(records: DataFrame, cases: DataFrame) -> DataFrame:
    """Target scope and matching targets on every record (JN-09, JN-10, JN-11).

    Cases without targets leave the stored scope as it is.
    """
    have = "applies_to_target_matrikel" in records.columns
    stored = F.col("applies_to_target_matrikel") if have else F.lit(None).cast("boolean")
    # written, so that the planner knows its size and need not shuffle the records by case
    parcels = materialize(
        cases.select(
            "case_id",
            P.parcel_keys("target_matrikler").alias("_targets"),
            P.parcel_keys("available_matrikler").alias("_available"),
            P.spelled_targets("target_matrikler").alias("_spelled"),
        )
    )
    joined = records.withColumn("_refs", P.parcel_keys("applies_to_matrikler")).join(parcels, "case_id", "left")
    refs, targets = F.col("_refs"), F.col("_targets")
    have_targets = F.coalesce(F.size(targets), F.lit(0)) > 0
    return joined.withColumns(
        {
            "applies_to_target_matrikel": F.when(
                have_targets, P.target_scope(refs, targets, F.col("_available"))
            ).otherwise(stored),
            "matching_targets": P.matching_targets(refs, F.col("_spelled")),
        }
    ).drop("_refs", "_targets", "_available", "_spelled")


def drop_repeats(records: DataFrame) -> DataFrame:
    """First record per date reference in id order; records without one are all kept (WIN-07)."""
    key = F.when(F.col("date_reference").isNull(), F.concat(F.lit("id:"), F.col("servitut_id"))).otherwise(
        F.concat(F.lit("ref:"), F.col("date_reference"))
    )
    return first_per_key(records, ["case_id", key], ["servitut_id"])


def _first_text(records: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """raw_text where a record's very first evidence lies outside the register extracts; else the further evidence is kept, else none."""
    first = F.get("evidence", F.lit(0))
    marked = records.withColumn("_doc", first["document_id"]).join(known.withColumn("_known", F.lit(True)), ["case_id", "_doc"], "left")
    open_ = F.col("_known").isNotNull()
    return marked.withColumns(
        {
            "raw_text": F.when(~open_, F.substring(first["text_excerpt"], 1, n)),
            "evidence": F.when(open_, F.slice("evidence", F.lit(2), F.size("evidence"))),
        }
    ).drop("_doc", "_known")


def _later_text(records: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """raw_text of the records that `_first_text` left open; the others stay where they are."""
    settled, open_ = records.where("evidence is null").drop("evidence"), records.where("evidence is not null")
    ev = open_.select("case_id", "servitut_id", F.posexplode("evidence").alias("_p", "_e")).select(
        "case_id", "servitut_id", "_p", F.col("_e.document_id").alias("_doc"), F.substring("_e.text_excerpt", 1, n).alias("_x")
    )
    later = ev.join(known, ["case_id", "_doc"], "left_anti").groupBy("case_id", "servitut_id").agg(F.min(F.struct("_p", "_x"))["_x"].alias("raw_text"))
    return settled.unionByName(open_.drop("raw_text", "evidence").join(later, ["case_id", "servitut_id"], "left"))


def _register_ids(register_docs: DataFrame) -> DataFrame:
    return materialize(register_docs.select("case_id", F.col("document_id").alias("_doc")).distinct())


def deed_text(records: DataFrame, register_docs: DataFrame, n: int = RAW_CHARS) -> DataFrame:
    """Records with the excerpt of their first evidence outside the register extracts as raw_text, in place of the evidence (JN-19)."""
    known = _register_ids(register_docs)
    return _later_text(_first_text(records, known, n), known, n)


def scope_label(c: Column | str) -> Column:
    """Ja / Nej / Måske from a nullable boolean (FLT-20)."""
    b = T.col(c)
    return F.when(b, fixed.SCOPE_YES).when(~b, fixed.SCOPE_NO).otherwise(fixed.SCOPE_MAYBE)


def scope_detail(matching: Column | str) -> Column:
    m = T.col(matching)
    return F.when(
        F.size(m) > 0, F.concat(F.lit(fixed.SCOPE_DETAIL_PREFIX), F.array_join(m, fixed.SCOPE_DETAIL_JOIN))
    )


def fill_empty(entries: DataFrame) -> DataFrame:
    """Fixed texts for empty description and action, and the amt warning (FLT-21)."""
    empty = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return entries.withColumns(
        {
            "description": F.when(
                empty("description"), F.when(empty("raw_text"), fixed.TEXT_NOT_REVIEWED).otherwise(fixed.TEXT_UNKNOWN)
            ).otherwise(F.col("description")),
            "action": F.when(empty("action"), fixed.TEXT_LOOK_UP).otherwise(F.col("action")),
            "beneficiary_amt_warning": T.has_amt("beneficiary"),
        }
    )


def number_entries(entries: DataFrame) -> DataFrame:
    """Entries numbered by date within the case, undated last (SRT-01, WIN-08); they are written once in this order."""
    dated = entries.where("case_id is not null and servitut_id is not null").withColumn("_d", D.sort_date("date_reference"))
    return numbered(dated, ["case_id"], ["_d", "servitut_id"], "nr").drop("_d")


def report_inputs(records: DataFrame, cases: DataFrame, day: str | None) -> DataFrame:
    """Records that enter a report: as-of, scope, de-duplicated."""
    return drop_repeats(annotate_scope(as_of(records, day), cases))


ENTRY_COLUMNS = [
    "case_id", "nr", "date_reference", "raw_text", "description", "beneficiary", "disposition", "legal_type", "action",
    "title", "byggeri_markering", "relevant_for_project", "beneficiary_amt_warning", "scope", "scope_detail", "servitut_id",
]


def _short_evidence() -> Column:
    """Of the evidence only documents and excerpts."""
    return F.transform("evidence", lambda e: F.struct(e["document_id"].alias("document_id"), e["text_excerpt"].alias("text_excerpt"))).alias("evidence")


def _light(records: DataFrame) -> DataFrame:
    """What an entry needs of a record; of the evidence only documents and excerpts."""
    return records.select(
        "case_id", "servitut_id", "date_reference", "title", "byggeri_markering", F.col("summary").alias("description"), "beneficiary",
        F.col("disposition_type").alias("disposition"), "legal_type", F.col("action_note").alias("action"),
        "applies_to_target_matrikel", scope_detail("matching_targets").alias("scope_detail"), _short_evidence(),
    )


def _entries(numbered_: DataFrame) -> DataFrame:
    """Entries from numbered light records with their deed text."""
    applies = F.col("applies_to_target_matrikel")
    return fill_empty(numbered_.withColumns({"relevant_for_project": F.coalesce(applies, F.lit(False)), "scope": scope_label(applies)})).select(*ENTRY_COLUMNS)


def build_report(records: DataFrame, cases: DataFrame, register_docs: DataFrame, day: str | None = None) -> DataFrame:
    """Numbered report entries of every case, from its records alone.

    The chosen records are written once, in the order of the report and without what no entry shows; most have lost their evidence
    for one text before they are shuffled.
    """
    known = _register_ids(register_docs)
    light = drop_repeats(_first_text(_light(annotate_scope(as_of(records, day), cases)), known, RAW_CHARS))
    return _entries(_later_text(number_entries(light), known, RAW_CHARS))


def answer_inputs(records: DataFrame, register_docs: DataFrame, day: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The records that enter a report as answers are completed from them: case, id, date and title, and the same with their deed text.

    They are written once; most have lost their evidence for one text before they are shuffled, and nothing else of a record travels.
    """
    known = _register_ids(register_docs)
    light = as_of(records, day).select("case_id", "servitut_id", "date_reference", "title", _short_evidence())
    chosen = materialize(drop_repeats(_first_text(light, known, RAW_CHARS)))
    return chosen.select("case_id", "servitut_id", "date_reference", "title"), _later_text(chosen, known, RAW_CHARS)


def final_report(
    records: DataFrame, cases: DataFrame, register_docs: DataFrame, answers: DataFrame, day: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entries and notes of every case: from its answer where that holds an object, else from its records (SET-02).

    `answers` has case_id and response_text. Entries are sorted by date and numbered anew either way.
    """
    known = _register_ids(register_docs)
    # written once without what no entry shows; most records have lost their evidence for one text before they are shuffled
    inputs = materialize(drop_repeats(_first_text(_light(annotate_scope(as_of(records, day), cases)), known, RAW_CHARS)))
    entries, notes = A.report_payload(answers)
    notes = materialize(notes)
    have = materialize(notes.select("case_id").distinct())
    side = inputs.join(have, "case_id", "left_semi").select("case_id", "servitut_id", "date_reference", "title", "raw_text", "evidence")
    told = answered_entries(entries, _later_text(side, known, RAW_CHARS), register_docs)
    told = position(told.withColumn("_d", D.sort_date("date_reference")), ["case_id"], {"d": F.col("_d")}, ["answer_nr", "servitut_id"], "nr").drop("_d")
    alone = _entries(_later_text(number_entries(inputs.join(have, "case_id", "left_anti")), known, RAW_CHARS))
    return told.select(*ENTRY_COLUMNS).unionByName(alone.select(*ENTRY_COLUMNS)), notes.where("notes is not null").distinct()


def answered_entries(payload: DataFrame, inputs: DataFrame, register_docs: DataFrame) -> DataFrame:
    """Entries of parsed answers, completed from the records by id, else by date (JN-13, JSN-06).

    Where a date occurs on several records the last one counts. `inputs` may have their deed text as raw_text already.
    """
    side = (inputs if "raw_text" in inputs.columns else deed_text(inputs, register_docs)).select(
        "case_id", "servitut_id", "date_reference", F.col("title").alias("_t"), F.col("raw_text").alias("_r")
    )
    by_id = side.select("case_id", "servitut_id", F.struct("_t", "_r").alias("_by_id"))
    by_date = (
        side.where("date_reference is not null")
        .groupBy("case_id", "date_reference")
        .agg(F.max(F.struct("servitut_id", "_t", "_r")).alias("_m"))
        .select("case_id", "date_reference", F.struct("_m._t", "_m._r").alias("_by_date"))
    )
    hit = F.coalesce("_by_id", "_by_date")
    dash = F.trim(F.coalesce("description", F.lit(""))).isin("—", "-", "")
    joined = payload.join(by_id, ["case_id", "servitut_id"], "left").join(by_date, ["case_id", "date_reference"], "left")
    done = joined.withColumns(
        {
            "description": F.when(
                hit.isNotNull() & dash & (F.coalesce(hit["_t"], F.lit("")) != ""),
                F.concat(F.lit(fixed.TEXT_NO_DEED_PREFIX), hit["_t"]),
            ).otherwise(F.col("description")),
            "raw_text": hit["_r"],
        }
    ).drop("_by_id", "_by_date")
    if "beneficiary" not in done.columns:
        done = done.withColumn("beneficiary", F.lit(None).cast("string"))
    return fill_empty(done)


def scope_entries(records: DataFrame, cases: DataFrame, day: str | None = None) -> DataFrame:
    """Case and scope of every report entry: what counts of a report read, without evidence, texts and numbers."""
    return report_inputs(records, cases, day).select("case_id", scope_label("applies_to_target_matrikel").alias("scope"))


def scope_counts(entries: DataFrame) -> DataFrame:
    """Entries per scope; a missing scope counts as Måske (AGG-12)."""
    s = F.coalesce("scope", F.lit(fixed.SCOPE_MAYBE))
    return entries.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(s == fixed.SCOPE_YES).alias("ja"),
        F.count_if(s == fixed.SCOPE_MAYBE).alias("maaske"),
        F.count_if(s == fixed.SCOPE_NO).alias("nej"),
    )


def marking_counts(records: DataFrame) -> DataFrame:
    """Marking and scope counters of the records of a case (AGG-13)."""
    m, a = F.col("byggeri_markering"), F.col("applies_to_target_matrikel")
    return records.groupBy("case_id").agg(
        F.count_if(m == "rød").alias("roed"),
        F.count_if(m == "orange").alias("orange"),
        F.count_if(m == "sort").alias("sort"),
        F.count_if(a).alias("ja"),
        F.count_if(~a).alias("nej"),
        F.count_if(a.isNull()).alias("uafklaret"),
        F.count_if(~F.col("attest_confirmed")).alias("unconfirmed"),
    )


def markdown_rows(entries: DataFrame) -> DataFrame:
    """One markdown line per entry (AGG-23, TXT-31)."""
    detail = F.coalesce(F.nullif("scope_detail", F.lit("")), F.col("scope"))
    cells = [F.col("nr"), F.col("date_reference"), F.col("title"), F.col("byggeri_markering"), F.col("description"),
             F.col("beneficiary"), F.col("disposition"), F.col("legal_type"), F.col("action"), detail]
    line = F.concat_ws(" | ", F.lit("|"), *[T.markdown_cell(c) for c in cells], F.lit("|"))
    return entries.select("case_id", (F.col("nr") + 2).alias("line_no"), line.alias("line"))


def markdown_table(entries: DataFrame) -> DataFrame:
    """The report table as numbered lines: header, divider, then entries.

    Lines stay rows, so a very large report is never gathered into one value; written out sorted by
    `line_no` they are the markdown document.
    """
    line = lambda no, text: F.struct(no.cast("bigint").alias("line_no"), text.alias("line"))
    own = line(F.col("line_no"), F.col("line"))
    # the first entry of a case, which is line 3, brings the two lines above it, so the entries are made once
    heads = [line(F.lit(1), F.lit(fixed.MARKDOWN_HEADER)), line(F.lit(2), F.lit(fixed.MARKDOWN_DIVIDER))]
    lines = F.when(F.col("line_no") == 3, F.array(*heads, own)).otherwise(F.array(own))
    return markdown_rows(entries).select("case_id", F.explode(lines).alias("h")).select("case_id", "h.line_no", "h.line")


def markdown_document(reports: DataFrame, entries: DataFrame) -> DataFrame:
    """Whole markdown document of each report as numbered lines (AGG-24).

    `reports` holds case_id, report_id, target_matrikler, available_matrikler, as_of_date and notes.
    """
    missing = F.lit("Ikke angivet")
    some = F.size("target_matrikler") > 0
    meta = F.when(
        some,
        F.array(
            F.concat(F.lit("**Projektmatrikler:** "), F.array_join("target_matrikler", ", ")),
            F.concat(F.lit("**Ejendommens matrikler:** "), F.coalesce(F.nullif(F.array_join("available_matrikler", ", "), F.lit("")), missing)),
            F.concat(F.lit("**Ajour pr. dato:** "), F.coalesce(F.col("as_of_date").cast("string"), missing)),
            F.lit(""),
        ),
    ).otherwise(F.array().cast("array<string>"))
    has_notes = F.coalesce("notes", F.lit("")) != ""
    notes = F.when(has_notes, F.array(F.lit("## Bemærkninger"), F.col("notes"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    title = F.array(F.concat(F.lit("# Rapport "), F.col("report_id")), F.lit(""))
    with_rows = entries.where("nr = 1").select("case_id").distinct().withColumn("_some", F.lit(True))
    head = reports.join(with_rows, "case_id", "left").withColumn("_table", F.coalesce("_some", F.lit(False)))
    tail = F.when(F.col("_table"), F.array(F.lit("## Tabel"))).otherwise(F.array(F.lit("## Rapportposter"), F.lit("")))
    # written, so that the lines of the table, most of them of a few cases, need not be shuffled by case
    head = materialize(head.select("case_id", "report_id", F.concat(title, meta, notes, tail).alias("_lines")))
    lead = head.select("case_id", "report_id", F.posexplode("_lines").alias("_i", "line")).select(
        "case_id", "report_id", (F.col("_i") + 1).cast("bigint").alias("line_no"), "line"
    )
    body = (
        markdown_table(entries)
        .join(head.select("case_id", "report_id", F.size("_lines").alias("_n")), "case_id")
        .select("case_id", "report_id", (F.col("line_no") + F.col("_n")).alias("line_no"), "line")
    )
    return lead.unionByName(body)


def editor_rows(entries: DataFrame) -> DataFrame:
    """Entries as an editor shows them: no nulls in text (FLT-26)."""
    texts = ["date_reference", "title", "byggeri_markering", "raw_text", "description", "beneficiary", "disposition",
             "legal_type", "action", "scope", "scope_detail"]
    return entries.na.fill("", subset=[c for c in texts if c in entries.columns])


def save_edited(rows: DataFrame, row_position: str = "row_position") -> DataFrame:
    """Edited rows back to entries: ordered by number then row, renumbered, blanks to null (WIN-09, TXT-27).

    `rows` carries nr as text or number and the integer position of the row in the editor.
    """
    asked = F.coalesce(F.col("nr").try_cast("int"), F.lit(fixed.EDITOR_MISSING_NR))
    texts = ["date_reference", "title", "byggeri_markering", "raw_text", "description", "beneficiary", "disposition",
             "legal_type", "action", "scope", "scope_detail"]
    ready = rows.withColumn("_asked", asked).drop("nr")
    out = numbered(ready, ["case_id"], ["_asked", row_position], "nr").drop("_asked", row_position)
    return out.withColumns(
        {
            **{c: T.blank_to_null(c) for c in texts if c in rows.columns},
            "relevant_for_project": F.coalesce("relevant_for_project", F.lit(False)),
            "beneficiary_amt_warning": F.coalesce("beneficiary_amt_warning", F.lit(False)),
            "servitut_id": F.coalesce(T.blank_to_null("servitut_id"), F.concat(F.lit("manual-row-"), F.col("nr").cast("string"))),
            "manually_edited": F.lit(True),
        }
    )


def latest_reports(reports: DataFrame) -> DataFrame:
    """Newest report of each case (WIN-12, SRT-08)."""
    return first_per_key(reports, ["case_id"], [F.desc("created_at"), "report_id"])
