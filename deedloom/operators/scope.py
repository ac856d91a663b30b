"""Parcels of a case and its target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deedloom import fixed
from deedloom.functions import parcels as P
from deedloom.operators.positions import first_per_key

DOC = ("case_id", "document_id")


def parse_parcels(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Parcels named on the first two pages of a case's register extracts, first mention wins (TXT-20, JN-20).

    `documents` has `pos`, the document's place in the case.
    """
    register = documents.where(F.col("document_type") == fixed.REGISTER_TYPE).select(*DOC, "pos")
    head = first_per_key(pages.select(*DOC, "page_number", "text").join(register, list(DOC)), DOC, ["page_number"], 2)
    # a block may start on the first page and end on the second, so the two are joined as the reader would see them
    both = head.groupBy(*DOC, "pos").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["text"]), "\n")
    rows = both.select("case_id", "pos", F.posexplode(P.parcel_blocks(text)).alias("i", "b")).select("case_id", "pos", "i", "b.*")
    key = F.coalesce(P.parcel_key("matrikelnummer"), F.col("matrikelnummer"))
    return first_per_key(rows.withColumn("parcel_key", key), ["case_id", "parcel_key"], ["pos", "i"])


def sync_targets(cases: DataFrame, parcels: DataFrame) -> DataFrame:
    """Current target kept in its parcel's spelling while valid, else the first parcel (JN-20)."""
    first = parcels.groupBy("case_id").agg(F.min(F.struct("pos", "i", "matrikelnummer")).alias("_f"))
    spelled = parcels.select("case_id", F.col("parcel_key").alias("_k"), F.col("matrikelnummer").alias("_m"))
    keyed = cases.withColumn("_k", P.parcel_key("target_matrikel"))
    return keyed.join(first, "case_id", "left").join(spelled, ["case_id", "_k"], "left").withColumn(
        "target_matrikel", F.coalesce("_m", "_f.matrikelnummer", "target_matrikel")
    ).drop("_k", "_m", "_f")


def choose_targets(cases: DataFrame, wishes: DataFrame, parcels: DataFrame) -> DataFrame:
    """Requested targets applied where they name a known parcel, or where the case has none (JN-20)."""
    have = parcels.select("case_id").distinct().withColumn("_some", F.lit(True))
    spelled = parcels.select("case_id", F.col("parcel_key").alias("_k"), F.col("matrikelnummer").alias("_m"))
    asked = wishes.select("case_id", F.col("matrikelnummer").alias("_w"), P.parcel_key("matrikelnummer").alias("_k"))
    free = F.col("_k").isNotNull() & F.col("_some").isNull()
    return cases.join(asked, "case_id", "left").join(have, "case_id", "left").join(spelled, ["case_id", "_k"], "left").withColumn(
        "target_matrikel", F.coalesce(F.col("_m"), F.when(free, F.lower(F.trim("_w"))), F.col("target_matrikel"))
    ).drop("_k", "_m", "_w", "_some")
