"""License scan by ordered signature rules.

A rule is a pair of regular expressions around one keyword: what must stand right before it and right after it. The
keyword is the prefilter: texts without any keyword are done after one set probe of their words, and a keyword meets
only its own rules. A detection is an interval of words with a priority; it is suppressed if its interval lies inside
that of a detection of higher priority, or of equal priority and greater length. Detections of the base phrases
always keep their label.

Rules are signatures of license texts, headers, links, identifiers and notices (`license_signatures`), and names in
contexts, built below from two short lists. A negation ("not licensed under the ...") is a rule without label that
suppresses the names inside it. Everything is inside the row: built-in functions only, no join, no shuffle, so no key
can be hot. Work is linear in the text: suppression looks at the neighbourhood that an interval can reach.

Edge cases: a null or empty text has no words, no labels, null positions and score 0; very long texts are read whole;
repeated rows give repeated results; a negation leaves base labels as they are; detections with equal interval and priority all stay; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from deedloom.llm.common import UPPER, columns
from deedloom.llm.license_signatures import signatures

# words looked at before and after a keyword; every rule fits
BEFORE, AFTER = 22, 16

# label, keyword, words before it, words after it, whether the name needs a context to count
NAMES = (
    ("mit", "mit", "", "", True), ("mit", "mit", "", "license ", False), ("mit", "expat", "", "(?:license )?", True),
    ("apache-2", "apache", "", "(?:license |software license )?(?:version |v)?2(?: 0)? ", False), ("apache-2", "apache", "", "license ", True),
    ("apache-1.1", "apache", "", "(?:license |software license )?(?:version )?1 1 ", False),
    ("bsd-2", "bsd", "(?:simplified |2 clause )?", "2 clause (?:license )?", False), ("bsd-2", "bsd", "(?:simplified |freebsd |2 clause )", "(?:license )?", False),
    ("bsd-3", "bsd", "", "3 clause (?:license )?", False), ("bsd-3", "bsd", "(?:new |modified |revised |3 clause )", "(?:license )?", False),
    ("bsd", "bsd", "", "(?:style )?license ", False),
    ("gpl", "gnu", "", "general public license ", False), ("gpl", "gpl", "(?:gnu )?", "(?:license )?", True),
    ("gpl-2", "gnu", "", "general public license (?:v2|v 2|version 2|2)(?: 0)? ", False), ("gpl-2", "gpl", "(?:gnu )?", "(?:license )?(?:v|version )?2(?: 0)? ", False),
    ("gpl-3", "gnu", "", "general public license (?:v3|v 3|version 3|3)(?: 0)? ", False), ("gpl-3", "gpl", "(?:gnu )?", "(?:license )?(?:v|version )?3(?: 0)? ", False),
    ("gpl-2", "gplv2", "(?:gnu )?", "", False), ("gpl-3", "gplv3", "(?:gnu )?", "", False),
    ("lgpl", "gnu", "", "(?:lesser|library) general public license ", False), ("lgpl-2.1", "lgpl", "(?:gnu )?", "(?:v|version )?2 1 ", False),
    ("lgpl-2.1", "gnu", "", "lesser general public license (?:version |v )?2 1 ", False),
    ("lgpl-3", "lgpl", "(?:gnu )?", "(?:v|version )?3(?: 0)? ", False), ("lgpl-3", "gnu", "", "lesser general public license (?:version |v )?3(?: 0)? ", False),
    ("agpl-3", "gnu", "", "affero general public license (?:version |v )?3?(?: 0)? ?", False), ("agpl-3", "agpl", "(?:gnu )?", "(?:v|version )?3(?: 0)? ", False),
    ("mpl-2", "mozilla", "", "public license (?:version |v )?2(?: 0)? ", False), ("mpl-2", "mpl", "", "(?:version |v)?2(?: 0)? ", False),
    ("mpl-1.1", "mozilla", "", "public license (?:version |v )?1 1 ", False), ("mpl-1.1", "mpl", "", "1 1 ", False),
    ("epl-1", "eclipse", "", "public license (?:version |v )?1(?: 0)? ", False), ("epl-2", "eclipse", "", "public license (?:version |v )?2(?: 0)? ", False),
    ("eclipse-distribution-1", "eclipse", "", "distribution license (?:version |v )?1(?: 0)? ", False), ("cddl-1", "cddl", "", "(?:version )?1(?: 0)? ", False),
    ("isc", "isc", "", "license ", False), ("isc", "isc", "", "", True), ("zlib", "zlib", "", "(?:libpng )?license ", False),
    ("unlicense", "unlicense", "the ", "", False), ("wtfpl", "wtfpl", "", "", False), ("bsl-1", "boost", "", "software license (?:version )?1?(?: 0)? ?", False),
    ("artistic-2", "artistic", "", "license (?:version )?2(?: 0)? ", False), ("eupl-1.2", "eupl", "", "(?:v|version )?1 2 ", False),
    ("ofl-1.1", "ofl", "(?:sil )?", "(?:version )?1 1 ", False), ("gfdl-1.3", "gfdl", "(?:gnu )?", "1 3 ", False),
    ("gfdl", "gnu", "", "free documentation license ", False), ("psf-2", "psf", "", "(?:license )?(?:version )?2(?: 0)? ", False),
    ("ms-pl", "microsoft", "", "public license ", False), ("ms-rl", "microsoft", "", "reciprocal license ", False), ("odbl-1", "odbl", "", "", False),
    ("cc0-1", "cc0", "", "(?:1 0 )?(?:universal )?", False), ("cc-by", "cc", "", "by (?:[1-4] [05] )?", False), ("cc-by-sa", "cc", "", "by sa (?:[1-4] [05] )?", False),
    ("cc-by-nd", "cc", "", "by nd (?:[1-4] [05] )?", False), ("cc-by-nc", "cc", "", "by nc (?:[1-4] [05] )?", False),
    ("cc-by-nc-sa", "cc", "", "by nc sa (?:[1-4] [05] )?", False), ("cc-by-nc-nd", "cc", "", "by nc nd (?:[1-4] [05] )?", False),
    ("cc-by", "creative", "", "commons attribution (?:[1-4] [05] )?(?:international )?(?:license )?", False),
    ("cc-by-sa", "creative", "", "commons attribution share ?alike (?:[1-4] [05] )?", False),
    ("cc-by-nc", "creative", "", "commons attribution non ?commercial (?:[1-4] [05] )?", False),
    ("cc-by-nd", "creative", "", "commons attribution no ?derivatives (?:[1-4] [05] )?", False),
)
# words before the name, priority
CONTEXTS = (
    ("spdx license identifier ", 95),
    ("(?:licensed|released|distributed|published|available|provided|shared) under (?:the terms of )?(?:an? |the )?", 90),
    ("(?:subject to|governed by) (?:the terms of )?(?:an? |the )?", 80),
    ("under (?:the terms of )?(?:an? |the )?", 60),
    ("licen[sc]e ", 50),
    ("", 30),
)
# label, keyword, before, after
BASE = (("mit", "mit", "under the ", "license "), ("apache-2", "apache", "", "license version 2 "), ("cc-by-nc", "cc", "", "by nc "))
BASE_PRIORITY = 70


def rules() -> list[tuple[str, str, str, str, int, bool]]:
    """label, keyword, before, after, priority, base: some hundreds."""
    out = [
        (label, key, f" {context}{left}$", f"^ {right}", priority, False)
        for label, key, left, right, weak in NAMES
        for context, priority in CONTEXTS
        if context or not weak
    ]
    out += [(label, key, f" {left}$", f"^ {right}", priority, False) for label, key, left, right, priority in signatures()]
    return out + [(label, key, f" {left}$", f"^ {right}", BASE_PRIORITY, True) for label, key, left, right in BASE]


def words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and non-ASCII characters; empty for a null."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(cut, "")


def _spaced(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.concat(F.lit(" "), F.array_join(parts, " "), F.lit(" "))).otherwise(F.lit(" "))


def _n(matched: Column) -> Column:
    """Words in a match: blanks less one, as it begins and ends with a blank."""
    return F.length(matched) - F.length(F.replace(matched, F.lit(" "))) - 1


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base positions, labels, score and the detections that stay."""
    table = rules()
    keys = sorted({r[1] for r in table})
    by_key = {k: [dict(zip(("label", "before", "after", "priority", "base"), (r[0], *r[2:]))) for r in table if r[1] == k] for k in keys}
    rule_map = F.from_json(F.lit(json.dumps(by_key)), "map<string,array<struct<label:string,before:string,after:string,priority:int,base:boolean>>>")
    key_list = F.array(*map(F.lit, keys))

    def at(i: Column) -> Column:
        left = _spaced(F.slice("words", F.greatest(F.lit(1), i + 1 - BEFORE), F.least(i, F.lit(BEFORE))))
        right = _spaced(F.slice("words", i + 2, F.lit(AFTER)))
        hits = F.filter(
            F.element_at(rule_map, F.get("words", i)), lambda r: F.rlike(left, r["before"]) & F.rlike(right, r["after"])
        )
        return F.transform(hits, lambda r: F.struct(
            (i - _n(F.regexp_substr(left, r["before"]))).cast("long").alias("start"),
            (i + 1 + _n(F.regexp_substr(right, r["after"]))).cast("long").alias("end"),
            r["priority"].alias("priority"), r["label"].alias("label"), r["base"].alias("base"),
        ))

    # an interval lies within the window of each word it holds, and a word gives no more than `most` of them
    reach = F.lit(BEFORE + AFTER + 1) * F.col("most")

    def suppressed(d: Column, k: Column) -> Column:
        near = F.slice("found", F.greatest(F.lit(1), k + 1 - reach), 2 * reach + 1)
        return F.exists(near, lambda e: (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (
            (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (e["end"] - e["start"] > d["end"] - d["start"]))
        ))

    kind = "array<struct<start:bigint,end:bigint,priority:int,label:string,base:boolean>>"
    cut = columns(docs, ("doc_id", "long"), ("text", "string")).select("doc_id", words(F.col("text")).alias("words"))
    gated = F.arrays_overlap("words", key_list)
    where = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(key_list, F.get("words", i)))
    spots = cut.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.coalesce(F.when(gated, F.transform(where, at)), F.array().cast(f"array<{kind}>")).alias("spots"),
    )
    found = spots.select("doc_id", "n_words", F.flatten("spots").alias("found"), F.coalesce(F.array_max(F.transform("spots", F.size)), F.lit(0)).alias("most"))
    kept = found.withColumns({
        "base": F.filter("found", lambda d: d["base"]),
        "kept": F.filter(F.filter("found", lambda d, k: ~suppressed(d, k)), lambda d: d["label"] != ""),
    })
    base_labels, labels = F.transform("base", lambda d: d["label"]), F.transform("kept", lambda d: d["label"])
    starts = F.transform("base", lambda d: d["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return kept.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, labels)).alias("labels"),
        (F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])), F.lit(0)) / 100).cast("double").alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"))).alias("detections"),
    )
