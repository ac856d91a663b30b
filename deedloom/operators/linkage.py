"""Linking deed records to register records.

Two references name the same record when their serials agree; else, unless both have a serial, when
their full dates agree; else, unless both have a full date, when their years agree and only one register
record of the case has that year. Each rule is an equality, so every record gives a few lookup keys and
all rules run as one equality join against an index that is aggregated to one row per key beforehand.
No pairs inside a case are ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deedloom import fixed
from deedloom.functions import dates as D, text as T

_SEP = "\x01"


def _key(kind: str, *parts: Column) -> Column:
    """Lookup key, null as soon as one part is missing."""
    return F.concat(F.lit(kind), *[F.concat(F.lit(_SEP), p) for p in parts])


def _components(df: DataFrame) -> DataFrame:
    c = D.date_components("date_reference")
    return df.withColumn("_c", c).withColumns(
        {"_full": F.col("_c.full_date"), "_lob": F.col("_c.lob_suffix"), "_year": F.col("_c.year")}
    ).drop("_c")


def _listed(scope: str, *lead: Column) -> list[Column]:
    """Keys under which a record can be found."""
    full, lob, year = F.col("_full"), F.col("_lob"), F.col("_year")
    return [
        _key(scope + "lob", *lead, lob),
        _key(scope + "full", *lead, full),
        F.when(lob.isNull(), _key(scope + "full-", *lead, full)),
        _key(scope + "year", *lead, year),
        F.when(full.isNull(), _key(scope + "year-", *lead, year)),
    ]


def _asked(scope: str, *lead: Column) -> list[Column]:
    """Keys under which a record looks for its match."""
    full, lob, year = F.col("_full"), F.col("_lob"), F.col("_year")
    return [
        _key(scope + "lob", *lead, lob),
        F.when(lob.isNull(), _key(scope + "full", *lead, full)).otherwise(_key(scope + "full-", *lead, full)),
        F.when(full.isNull(), _key(scope + "year", *lead, year)).otherwise(_key(scope + "year-", *lead, year)),
    ]


def _exploded(df: DataFrame, keys: list[Column], *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("_k"))


def year_counts(canonicals: DataFrame) -> DataFrame:
    """Register records per case and year (AGG-10)."""
    return _components(canonicals).where("_year is not null").groupBy("case_id", F.col("_year").alias("year")).agg(
        F.count(F.lit(1)).alias("records")
    )


def archive_groups(canonicals: DataFrame) -> DataFrame:
    """Register records per archive id; more than one means the id alone decides nothing (AGG-11)."""
    return canonicals.where(F.coalesce("akt_nr", F.lit("")) != "").groupBy(
        "case_id", T.archive_key("akt_nr").alias("akt_key")
    ).agg(F.count(F.lit(1)).alias("records"), F.min("ord").alias("first_ord"))


def canonical_key() -> Column:
    """The date reference, or the record's own id where it has none."""
    return F.coalesce(F.nullif("date_reference", F.lit("")), F.concat(F.lit("id:"), F.col("servitut_id")))


def _canonical_index(canonicals: DataFrame) -> DataFrame:
    """One row per (case, lookup key): the step it belongs to and the first register record behind it."""
    base = _components(canonicals.select("case_id", "ord", "servitut_id", "date_reference", "akt_nr"))
    base = base.withColumn("_ck", canonical_key()).withColumn("_akt", F.nullif(T.archive_key("akt_nr"), F.lit("")))
    years = base.where("_year is not null").groupBy("case_id", "_year").agg(F.count(F.lit(1)).alias("_in_year"))
    aktn = base.where("_akt is not null").groupBy("case_id", "_akt").agg(F.count(F.lit(1)).alias("_in_akt"))
    firsts = base.groupBy("case_id", "_ck").agg(F.min("ord").alias("_first"))
    full = (
        base.join(years, ["case_id", "_year"], "left").join(aktn, ["case_id", "_akt"], "left").join(firsts, ["case_id", "_ck"])
        .withColumn("_year", F.when(F.col("_in_year") == 1, F.col("_year")))
    )
    akt, shared = F.col("_akt"), F.col("_in_akt") > 1
    ref = F.nullif("date_reference", F.lit(""))
    groups = [
        (1, [F.when(F.col("_in_akt") == 1, _key("akt", akt))]),
        (2, [F.when(shared, _key("akt+date", akt, ref))]),
        (3, [F.when(shared, k) for k in _listed("akt+", akt)]),
        (4, [_key("date", ref)]),
        (5, _listed("")),
    ]
    entry = lambda step, k: F.when(k.isNotNull(), F.struct(F.lit(step).alias("step"), k.alias("_k")))
    rows = F.array_compact(F.array(*[entry(step, k) for step, ks in groups for k in ks]))
    return full.select("case_id", "_first", F.explode(rows).alias("_e")).groupBy(
        "case_id", F.col("_e._k").alias("_k")
    ).agg(F.min(F.struct(F.col("_e.step").alias("step"), F.col("_first").alias("first_ord"))).alias("_hit"))


def resolve_keys(items: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Items with the register record they describe and how strongly: 1 archive id, 2 date, 3 fuzzy date (JN-03).

    An archive id that several register records share counts only together with the item's date.
    Adds matched_ord (the record's list position) and match_priority, both null without a match.
    """
    base = _components(items.withColumn("_row", F.struct("case_id", "ord")))
    akt, ref = F.nullif(T.archive_key("akt_nr"), F.lit("")), F.nullif("date_reference", F.lit(""))
    keys = [_key("akt", akt), _key("akt+date", akt, ref), *_asked("akt+", akt), _key("date", ref), *_asked("")]
    probes = _exploded(base, keys, "case_id", "ord")
    best = probes.join(_canonical_index(canonicals), ["case_id", "_k"]).groupBy("case_id", "ord").agg(F.min("_hit").alias("_hit"))
    step = F.col("_hit.step")
    return items.join(best, ["case_id", "ord"], "left").withColumns(
        {
            "matched_ord": F.col("_hit.first_ord"),
            "match_priority": F.when(step <= 3, 1).when(step == 4, 2).when(step == 5, 3),
        }
    ).drop("_hit")


def answer_confidence(c: Column | str = "confidence") -> Column:
    """Missing and zero count as one half."""
    return F.coalesce(F.nullif(T.col(c).cast("double"), F.lit(0.0)), F.lit(0.5))


def best_items(resolved: DataFrame) -> DataFrame:
    """Best item per register record: stronger match, then confidence, then earlier (AGG-19)."""
    order = F.struct(F.col("match_priority"), -answer_confidence(), F.col("ord"))
    return resolved.where("matched_ord is not null").groupBy("case_id", "matched_ord").agg(
        F.min_by("ord", order).alias("item_ord"), F.min("match_priority").alias("match_priority")
    )


def orphans(resolved: DataFrame) -> DataFrame:
    """Items that no register record explains, best per archive id or date, unconfirmed (JN-07)."""
    key = F.coalesce(F.nullif(T.archive_key("akt_nr"), F.lit("")), F.nullif("date_reference", F.lit("")))
    left = resolved.where(F.col("matched_ord").isNull()).withColumn("orphan_key", key).where("orphan_key is not null")
    best = left.groupBy("case_id", "orphan_key").agg(F.min_by("ord", F.struct(-answer_confidence(), F.col("ord"))).alias("ord"))
    kept = left.drop("orphan_key").join(best, ["case_id", "ord"])
    return kept.withColumns({"confidence": answer_confidence(), "attest_confirmed": F.lit(False)}).drop(
        "matched_ord", "match_priority"
    )


_TAKEN = ("summary", "beneficiary", "disposition_type", "legal_type", "action_note", "byggeri_markering")
_SCOPE = ("raw_matrikel_references", "raw_scope_text", "scope_source", "scope_basis", "scope_confidence", "applies_to_target_matrikel")


def enriched(canonicals: DataFrame, deeds: DataFrame, on: Column) -> DataFrame:
    """Register records completed from their deed record, field by field (FLT-22).

    `deeds` has its columns prefixed with d_. Texts of the deed win, the register's own scope stays.
    """
    have = set(canonicals.columns)
    joined = canonicals.join(deeds, on, "left")
    given = F.col("d_ord").isNotNull()
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    lists = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) > 0
    own_scope = lists("applies_to_matrikler")
    if "raw_matrikel_references" in have:
        own_scope = own_scope | lists("raw_matrikel_references")
    if "raw_scope_text" in have:
        own_scope = own_scope | (F.coalesce("raw_scope_text", F.lit("")) != "")
    new = {
        "confidence": F.when(given, F.greatest("confidence", "d_confidence")).otherwise(F.col("confidence")),
        "source_document": F.coalesce("d_document_id", "source_document"),
        "akt_nr": F.coalesce(text("d_akt_nr"), F.col("akt_nr")),
        "applies_to_matrikler": F.when(~own_scope & lists("d_applies_to_matrikler"), F.col("d_applies_to_matrikler")).otherwise(
            F.col("applies_to_matrikler")
        ),
    }
    d_have = set(deeds.columns)
    for c in _TAKEN:
        if f"d_{c}" in d_have:
            mine = F.col(c) if c in have else F.lit(None).cast("string")
            new[c] = F.coalesce(text(f"d_{c}"), mine)
    for c in _SCOPE:
        if f"d_{c}" in d_have and c in have:
            kind = deeds.schema[f"d_{c}"].dataType.typeName()
            filled = lists(f"d_{c}") if kind == "array" else text(f"d_{c}").isNotNull() if kind == "string" else F.col(f"d_{c}").isNotNull()
            new[c] = F.when(~own_scope & filled, F.col(f"d_{c}")).otherwise(F.col(c))
    if "scope_source" in have:
        # scope of its own without a source counts as the register's
        unnamed = given & own_scope & text("scope_source").isNull()
        new["scope_source"] = F.when(unnamed, F.lit("attest")).otherwise(new.get("scope_source", F.col("scope_source")))
    if "construction_relevance" in have and "d_construction_relevance" in d_have:
        new["construction_relevance"] = F.when(F.col("d_construction_relevance"), F.lit(True)).otherwise(F.col("construction_relevance"))
    if "registered_at" in have and "d_registered_at" in d_have:
        new["registered_at"] = F.coalesce("registered_at", "d_registered_at")
    if "evidence" in have and "d_evidence" in d_have:
        new["evidence"] = F.when(given, F.concat("evidence", "d_evidence")).otherwise(F.col("evidence"))
    return joined.withColumns(new).drop(*[c for c in deeds.columns])


def _by_first(canonicals: DataFrame) -> DataFrame:
    """Register records with the first list position among those of the same date reference."""
    firsts = canonicals.groupBy("case_id", canonical_key().alias("_ck")).agg(F.min("ord").alias("_first"))
    return canonicals.withColumn("_ck", canonical_key()).join(firsts, ["case_id", "_ck"]).drop("_ck")


def _orphan_id() -> Column:
    return T.entity_id("srv-", F.col("case_id"), F.col("document_id"), F.col("orphan_key"))


def enrichment_links(canonicals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Which deed item stands behind which record: case_id, servitut_id, item_ord, document_id, date_reference, akt_nr.

    One row per enriched register record and per orphan. Date and archive id are those of the item, else of the
    record: under them the deed's chunks are searched for evidence.
    """
    best = best_items(resolved).select("case_id", F.col("matched_ord").alias("_first"), F.col("item_ord").alias("ord"))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    item = resolved.join(best, ["case_id", "ord"]).select(
        "case_id", "_first", F.col("ord").alias("item_ord"), "document_id", text("date_reference").alias("_date"), text("akt_nr").alias("_akt")
    )
    known = _by_first(canonicals.select("case_id", "ord", "servitut_id", "date_reference", "akt_nr")).join(item, ["case_id", "_first"]).select(
        "case_id", "servitut_id", "item_ord", "document_id", F.coalesce("_date", "date_reference").alias("date_reference"),
        F.coalesce("_akt", "akt_nr").alias("akt_nr"),
    )
    alone = orphans(resolved).select(
        "case_id", _orphan_id().alias("servitut_id"), F.col("ord").alias("item_ord"), "document_id", "date_reference", "akt_nr"
    )
    return known.unionByName(alone)


def _prefixed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"d_{c}") for c in df.columns])


def enrich_canonicals(canonicals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Register records enriched by their best item, plus the orphans (SET-01).

    All register records with the same date reference share that item.
    """
    best = best_items(resolved).select("case_id", F.col("matched_ord").alias("_first"), F.col("item_ord").alias("ord"))
    chosen = resolved.drop("matched_ord", "match_priority").join(best, ["case_id", "ord"]).withColumn("confidence", answer_confidence())
    deeds = _prefixed(chosen)
    done = enriched(_by_first(canonicals), deeds, (F.col("case_id") == F.col("d_case_id")) & (F.col("_first") == F.col("d__first")))
    done = done.drop("_first").withColumn("attest_confirmed", F.lit(True))
    extra = orphans(resolved).withColumn("servitut_id", _orphan_id()).withColumnRenamed("document_id", "source_document")
    return done.unionByName(extra.drop("orphan_key"), allowMissingColumns=True)


def _deed_index(deeds: DataFrame) -> DataFrame:
    base = _components(deeds.select("case_id", "ord", "date_reference", "confidence"))
    return _exploded(base, _listed(""), "case_id", "ord", "confidence").groupBy("case_id", "_k").agg(
        F.max(F.struct(F.col("confidence"), (-F.col("ord")).alias("_neg"))).alias("_best"), F.count(F.lit(1)).alias("_n")
    )


def _canonical_probes(canonicals: DataFrame) -> DataFrame:
    base = _components(canonicals.select("case_id", "ord", "servitut_id", "date_reference"))
    years = base.where("_year is not null").groupBy("case_id", "_year").agg(F.count(F.lit(1)).alias("_in_year"))
    lone = base.join(years, ["case_id", "_year"], "left").withColumn("_year", F.when(F.col("_in_year") == 1, F.col("_year")))
    return _exploded(lone, _asked(""), "case_id", "ord", "servitut_id")


def match_counts(canonicals: DataFrame, deeds: DataFrame) -> DataFrame:
    """How many deed records match each register record, and the best of them (JN-04, first half of JN-05)."""
    # the keys a record asks under never overlap, so counts add up
    hits = _canonical_probes(canonicals).join(_deed_index(deeds), ["case_id", "_k"])
    return hits.groupBy("case_id", "ord", "servitut_id").agg(
        F.sum("_n").alias("matches"), F.max("_best").alias("_best")
    ).select("case_id", "ord", "servitut_id", "matches", (-F.col("_best._neg")).alias("deed_ord"))


def merge_best(canonicals: DataFrame, deeds: DataFrame) -> DataFrame:
    """Register records enriched by their most confident matching deed record, first on ties (JN-05)."""
    best = match_counts(canonicals, deeds).select("case_id", F.col("ord").alias("c_ord"), F.col("deed_ord").alias("ord"))
    chosen = _prefixed(deeds.join(best, ["case_id", "ord"]))
    return enriched(
        canonicals, chosen, (F.col("case_id") == F.col("d_case_id")) & (canonicals["ord"] == F.col("d_c_ord"))
    )


def discarded(canonicals: DataFrame, deeds: DataFrame) -> DataFrame:
    """Deed records that match no register record (JN-06)."""
    base = _components(canonicals.select("case_id", "ord", "servitut_id", "date_reference"))
    years = base.where("_year is not null").groupBy("case_id", "_year").agg(F.count(F.lit(1)).alias("_in_year"))
    lone = base.join(years, ["case_id", "_year"], "left").withColumn("_year", F.when(F.col("_in_year") == 1, F.col("_year")))
    index = _exploded(lone, _listed(""), "case_id").distinct()
    asked = _exploded(_components(deeds), _asked(""), "case_id", "ord")
    found = asked.join(index, ["case_id", "_k"], "left_semi").select("case_id", "ord").distinct()
    return deeds.join(found, ["case_id", "ord"], "left_anti")
