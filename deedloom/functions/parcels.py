"""Parcel numbers: normal form, parsing and three-valued scope."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deedloom import fixed
from deedloom.functions.text import col, strip


def parcel_key(c: Column | str) -> Column:
    """Blanks dropped, lower case, leading zeros of the number dropped; others kept as is (TXT-18)."""
    t = F.nullif(F.lower(F.regexp_replace(col(c), "[" + fixed.BLANK + "]+", "")), F.lit(""))
    return F.when(t.rlike("^[0-9]+[a-z]*$"), F.regexp_replace(t, r"^0+(?=[0-9])", "")).otherwise(t)


def parcel_keys(a: Column | str) -> Column:
    """Normal forms of a list, distinct in order, empties dropped (TXT-19)."""
    normal = F.transform(col(a), parcel_key)
    return F.coalesce(F.array_distinct(F.filter(normal, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def parcel_blocks(c: Column | str) -> Column:
    """District, number and area of each block in the text, in order (first half of TXT-20)."""
    groups = [F.regexp_extract_all(col(c), F.lit(fixed.PARCEL_BLOCK), F.lit(g)) for g in (1, 2, 3)]
    return F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("district", "number", "area"))]),
        lambda z: F.struct(
            F.lower(z["number"]).alias("matrikelnummer"),
            F.trim(F.regexp_replace(z["district"], "[" + fixed.BLANK + "]+", " ")).alias("landsejerlav"),
            z["area"].try_cast("bigint").alias("areal_m2"),
        ),
    )


def target_scope(refs: Column, targets: Column, available: Column) -> Column:
    """True on overlap; null without targets, without refs or with only unknown refs; else false (JN-09).

    All three are lists in normal form (`parcel_keys`).
    """
    return (
        F.when((F.size(targets) == 0) | (F.size(refs) == 0), F.lit(None).cast("boolean"))
        .when(F.arrays_overlap(refs, targets), F.lit(True))
        .when((F.size(available) > 0) & ~F.arrays_overlap(refs, available), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def spelled_targets(targets: Column | str) -> Column:
    """Targets in their own spelling (trimmed, lower case) next to their normal form."""
    cleaned = F.transform(col(targets), lambda x: F.lower(strip(x)))
    return F.coalesce(
        F.array_distinct(F.transform(cleaned, lambda x: F.struct(x.alias("shown"), parcel_key(x).alias("key")))),
        F.array().cast("array<struct<shown:string,key:string>>"),
    )


def matching_targets(refs: Column, spelled: Column) -> Column:
    """Targets that the refs (in normal form) name, in the targets' own spelling (JN-10)."""
    hit = F.filter(spelled, lambda t: F.coalesce(F.array_contains(refs, t["key"]), F.lit(False)))
    return F.transform(hit, lambda t: t["shown"])
