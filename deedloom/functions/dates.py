"""Date references and registration dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deedloom import fixed
from deedloom.functions.text import col, strip


def far_future() -> Column:
    return F.lit("9999-12-31").cast("date")


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _padded(c: Column, pattern: str) -> Column:
    d, m, y = (_part(c, pattern, g) for g in (1, 2, 3))
    return F.concat(F.lpad(d, 2, "0"), F.lit("."), F.lpad(m, 2, "0"), F.lit("."), y)


def date_components(c: Column | str) -> Column:
    """full_date, lob_suffix and year of a reference, from three patterns tried in turn (TXT-21)."""
    t = col(c)
    serial = _part(t, fixed.DATED_SERIAL, 4)
    full = F.when(serial.isNotNull(), _padded(t, fixed.DATED_SERIAL)).otherwise(_padded(t, fixed.LOOSE_DATE))
    year = F.coalesce(F.right(full, F.lit(4)), _part(t, fixed.LONE_YEAR, 1))
    return F.struct(full.alias("full_date"), serial.alias("lob_suffix"), year.alias("year"))


def _date_in(c: Column) -> Column:
    t = strip(c)
    iso_text = F.substring(t, 1, 10)
    iso = F.when(iso_text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(iso_text, "yyyy-MM-dd"))
    d, m, y = (_part(t, fixed.TIGHT_DATE, g) for g in (1, 2, 3))
    loose = F.try_to_date(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.coalesce(iso, loose)


def registered_at(value: Column | str, reference: Column | str) -> Column:
    """ISO prefix or d.m.y / d/m/y of the value, else of the reference (TXT-24)."""
    return F.coalesce(_date_in(col(value)), _date_in(col(reference)))


def sort_date(c: Column | str) -> Column:
    """Strict dd.mm.yyyy of the first ten characters, else far future (TXT-25)."""
    head = F.substring(col(c), 1, 10)
    return F.coalesce(F.try_to_date(F.when(head.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), head), "d.M.yyyy"), far_future())
