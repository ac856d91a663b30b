"""Page ranges of large scans: suggestion, parsing with checks, and assignment of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from deedloom.functions import text as T


def suggest_ranges(documents: DataFrame, pages: str = "page_count", per_part: int = 100) -> DataFrame:
    """Parts of at most `per_part` pages (GEN-02)."""
    total = F.col(pages).cast("int")
    rows = documents.where(total >= 1).select("document_id", total.alias("_t"), F.posexplode(F.sequence(F.lit(1), total, F.lit(per_part))).alias("_i", "start_page"))
    return rows.select(
        "document_id", (F.col("_i") + 1).alias("part"), "start_page",
        F.least(F.col("start_page") + per_part - 1, F.col("_t")).alias("end_page"),
    ).withColumn("line", F.format_string("%d-%d | Del %d", "start_page", "end_page", "part"))


def parse_ranges(specs: DataFrame) -> DataFrame:
    """Lines 'a-b | label' to ranges with an error text where a line breaks a rule (GEN-03, WIN-11).

    `specs` has document_id, spec and total_pages. Overlap is checked on lines that are valid by
    themselves. A spec is one person's input, so a window per document is small.
    """
    lines = specs.select("document_id", "total_pages", F.posexplode(T.lines("spec")).alias("_i", "raw"))
    lines = lines.withColumns({"line_number": F.col("_i") + 1, "line": T.strip("raw")}).where("line <> ''")
    interval = T.strip(F.split_part("line", F.lit("|"), F.lit(1)))
    label = T.blank_to_null(F.when(F.contains("line", F.lit("|")), F.regexp_replace("line", r"^[^|]*\|", "")))
    dashed = F.contains(F.col("interval"), F.lit("-"))
    first = F.when(dashed, T.strip(F.regexp_extract("interval", r"^([^-]*)-", 1))).otherwise(F.col("interval"))
    last = F.when(dashed, T.strip(F.regexp_extract("interval", r"^[^-]*-(.*)$", 1))).otherwise(F.col("interval"))
    p = lines.withColumns({"interval": interval, "label": label}).withColumns(
        {"start_page": first.try_cast("int"), "end_page": last.try_cast("int")}
    )
    a, b = F.col("start_page"), F.col("end_page")
    at = F.concat(F.lit("Linje "), F.col("line_number").cast("string"), F.lit(": "))
    error = (
        F.when(F.col("interval") == "", F.concat(at, F.lit("mangler sideinterval")))
        .when(a.isNull() | b.isNull(), F.concat(at, F.lit("ugyldigt sideinterval '"), F.col("interval"), F.lit("'")))
        .when((a < 1) | (b < 1), F.concat(at, F.lit("sidetal skal starte ved 1")))
        .when(a > b, F.concat(at, F.lit("startside må ikke være større end slutside")))
        .when(b > F.col("total_pages"), F.concat(at, F.lit("side "), b.cast("string"), F.lit(" findes ikke i PDF'en ("), F.col("total_pages").cast("string"), F.lit(" sider)")))
    )
    checked = p.withColumn("error", error)
    ok = F.when(F.col("error").isNull(), F.col("end_page"))
    earlier = F.max(ok).over(
        Window.partitionBy("document_id").orderBy("start_page", "end_page", "line_number").rowsBetween(Window.unboundedPreceding, -1)
    )
    overlap = F.col("error").isNull() & (F.col("start_page") <= F.col("_end"))
    return checked.withColumn("_end", earlier).withColumn(
        "error", F.when(overlap, F.lit("Sideintervaller må ikke overlappe")).otherwise(F.col("error"))
    ).select("document_id", "line_number", "start_page", "end_page", "label", "error")


def assign_parts(pages: DataFrame, ranges: DataFrame, stem: str = "document_id") -> DataFrame:
    """Every page with the part it falls into and the part's file name, null where uncovered (GEN-04, TXT-32)."""
    valid = ranges.where("error is null")
    part = F.row_number().over(Window.partitionBy("document_id").orderBy("line_number"))
    named = valid.withColumn("part", part).select(
        "document_id", "part", F.concat(F.col(stem), F.lit("_"), T.part_label(F.col("label"), F.col("part"), F.col("start_page"), F.col("end_page")), F.lit(".pdf")).alias("part_file"),
        F.explode(F.sequence("start_page", "end_page")).alias("page_number"),
    )
    return pages.join(named, ["document_id", "page_number"], "left")
