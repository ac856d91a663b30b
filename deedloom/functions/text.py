"""String scalars as Column -> Column; all JVM-side, no Python in the row path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from deedloom import fixed

# every character Python's str.strip() removes
STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(STRIP_CHARS))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(STRIP_CHARS))


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text, or null when nothing is left (TXT-22)."""
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def clean_text(c: Column | str) -> Column:
    """Line ends to \\n, 3+ newlines to two, blanks and tabs to one space, trimmed (TXT-01)."""
    t = F.regexp_replace(col(c), "\r\n?", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    # single blanks, nearly all of them, are left alone
    t = F.regexp_replace(t, "[ \t]{2,}|\t", " ")
    return strip(t)


def paragraphs(c: Column | str) -> Column:
    """Non-empty stripped paragraphs (TXT-02)."""
    return F.filter(F.transform(F.split(col(c), "\n{2,}"), strip), lambda p: p != "")


def lines(c: Column | str) -> Column:
    return F.split(col(c), LINE_BREAK)


def count_contained(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the (already lower-cased) text, each counted once."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(c, F.lit(w)).cast("int")
    return total


def has_keywords(c: Column | str, words: Sequence[str] = tuple(fixed.RECORD_KEYWORDS), threshold: int = 1) -> Column:
    """At least `threshold` of the words occur (TXT-03); one hit is enough to stop when it is 1."""
    low = F.lower(col(c))
    if threshold <= 1:
        hit = F.lit(threshold <= 0)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        return hit
    return count_contained(low, words) >= threshold


def distinct_nonempty(a: Column) -> Column:
    """First-seen order kept, empty strings dropped (TXT-16)."""
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))


def date_strings(c: Column | str) -> Column:
    """All date-like strings, distinct and sorted (TXT-04)."""
    found = [F.regexp_extract_all(col(c), F.lit(p), F.lit(0)) for p in fixed.DATE_PATTERNS]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def serial_numbers(c: Column | str) -> Column:
    """Serial-number tokens (TXT-05)."""
    return F.regexp_extract_all(col(c), F.lit(fixed.SERIAL_NUMBER), F.lit(0))


def is_admin_page(c: Column | str, pattern: str = fixed.ADMIN_HEADER) -> Column:
    """Cover sheet test on the first stripped characters (TXT-06)."""
    return F.substring(strip(c), 1, fixed.ADMIN_HEADER_CHARS).rlike(pattern)


def text_quality(c: Column | str) -> Column:
    """Share of letters and digits, mapped from [.10, .50] to [0, 1] (TXT-07)."""
    t = col(c)
    alnum = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", ""))
    share = (alnum / F.length(t) - F.lit(0.10)) / F.lit(0.40)
    return F.when(F.length(t) > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), 3)).otherwise(F.lit(0.0))


def archive_key(c: Column | str) -> Column:
    """Blanks and hyphens dropped, lower case (TXT-08)."""
    return F.lower(F.regexp_replace(col(c), "[" + fixed.BLANK + r"\-]+", ""))


def match_key(c: Column | str) -> Column:
    """Blanks, dots and hyphens dropped, lower case (TXT-09)."""
    return F.lower(F.regexp_replace(col(c), "[" + fixed.BLANK + r".\-]+", ""))


def merge_key(c: Column | str) -> Column:
    """Only [0-9a-z] kept after lowering; null when empty (TXT-10)."""
    return F.nullif(F.regexp_replace(F.lower(col(c)), "[^0-9a-z]+", ""), F.lit(""))


def heading(c: Column | str, skip: Sequence[str] = tuple(fixed.HEADING_SKIP)) -> Column:
    """First line of at least 4 characters that is not boiler-plate, cut at 160 (TXT-11)."""
    stripped = F.transform(lines(c), strip)
    kept = F.filter(stripped, lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*skip))
    return F.substring(F.try_element_at(kept, F.lit(1)), 1, 160)


def _is_scope_line(x: Column) -> Column:
    low = F.lower(x)
    return F.contains(low, F.lit("vedr")) | F.contains(low, F.lit("matr"))


def scope_line(c: Column | str) -> Column:
    """First line that names a scope, cut at 240 (TXT-12)."""
    kept = F.filter(F.transform(lines(c), strip), _is_scope_line)
    return F.substring(F.try_element_at(kept, F.lit(1)), 1, 240)


def parcel_refs(c: Column | str) -> Column:
    """Parcel tokens of the scope lines, lower case, first-seen order (TXT-13)."""
    scope = F.array_join(F.filter(F.transform(lines(c), strip), _is_scope_line), " ")
    found = F.regexp_extract_all(scope, F.lit(fixed.PARCEL_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def starts_new_entry(c: Column | str) -> Column:
    """A date reference within the first 12 lines (TXT-14)."""
    return F.array_join(F.slice(lines(c), 1, 12), "\n").rlike(fixed.DATE_REFERENCE)


def first_matches(c: Column | str, pattern: str, n: int = 10) -> Column:
    """Distinct matches in order, first n (TXT-15)."""
    found = F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))
    return F.slice(distinct_nonempty(found), 1, n)


def text_hash(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def chunk_id(doc: Column | str, page: Column | str, index: Column | str) -> Column:
    """First 12 hex digits of sha256('doc:page:index') (TXT-33)."""
    joined = F.concat_ws(":", col(doc), col(page).cast("string"), col(index).cast("string"))
    return F.substring(F.sha2(joined, 256), 1, 12)


def entity_id(prefix: str, *natural_key: Column) -> Column:
    """Prefix and digest of a natural key, so a retried task gives the same id (TXT-34).

    Ids are keys of joins, so the digest is whole; `short_id` shortens one for display.
    """
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *natural_key), 256))


def short_id(c: Column | str) -> Column:
    """Prefix and the first 8 hex digits of an id, for display only."""
    return F.regexp_replace(col(c), r"^(.*-)?([0-9a-f]{8})[0-9a-f]{56}$", "$1$2")


def query_words(*parts: Column) -> Column:
    """Words of 3+ characters of the joined parts, distinct in order (TXT-28)."""
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit(fixed.QUERY_WORD), F.lit(0)))


def overlap_score(text: Column, words: Column) -> Column:
    """Share of the words contained in the text (TXT-29)."""
    low = F.lower(text)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))


def has_amt(c: Column | str) -> Column:
    """'amt' as a whole word (TXT-30)."""
    return F.coalesce(col(c).rlike(fixed.AMT_WORD), F.lit(False))


def markdown_cell(c: Column | str) -> Column:
    """Dash for empty, newlines to blanks, pipe escaped (TXT-31)."""
    t = F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(fixed.EMPTY_CELL))
    t = strip(F.array_join(F.split(F.regexp_replace(t, "(?:" + LINE_BREAK + ")$", ""), LINE_BREAK), " "))
    return F.replace(t, F.lit("|"), F.lit("\\|"))


def download_name(c: Column | str) -> Column:
    """Characters that no file system takes become underscores; 'fil' when empty (TXT-32)."""
    t = strip(F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("fil"))


def filename_component(c: Column | str) -> Column:
    """Blanks to underscores, other unusual characters to hyphens, edges trimmed (TXT-32)."""
    t = F.regexp_replace(strip(c), "[" + fixed.BLANK + "]+", "_")
    t = F.regexp_replace(t, "[^0-9A-Za-z._-]+", "-")
    t = F.trim(t, F.lit("._-"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("del"))


def part_label(label: Column, index: Column, start: Column, end: Column) -> Column:
    generated = F.format_string("del-%02d_p%d-%d", index.cast("int"), start.cast("int"), end.cast("int"))
    return F.when(F.coalesce(label, F.lit("")) != "", filename_component(label)).otherwise(generated)


def keyword_in_context(c: Column | str, words: Sequence[str] = tuple(fixed.RECORD_KEYWORDS), lead: int = 60, width: int = 300) -> Column:
    """Text around the first listed word that occurs; plain head otherwise (TXT-35)."""
    t = col(c)
    low = F.lower(t)
    out = F.substring(t, 1, width)
    for w in reversed(words):
        at = F.instr(low, w)
        cut = t.substr(F.greatest(at - F.lit(lead), F.lit(1)), F.lit(width))
        out = F.when(at > 0, F.concat(F.lit("..."), cut, F.lit("..."))).otherwise(out)
    return out


def excerpt(c: Column | str, n: int = 300) -> Column:
    return F.substring(col(c), 1, n)


def validated_type(c: Column | str) -> Column:
    """Requested document type, trimmed and lowered; null for any other text, which `type_error` names (TXT-37)."""
    t = F.lower(strip(c))
    return F.when(t.isin(fixed.DEED_TYPE, fixed.REGISTER_TYPE), t)


def type_error(c: Column | str) -> Column:
    """Message for a requested type that is not known, else null: one bad row does not stop a job."""
    return F.when(col(c).isNotNull() & validated_type(c).isNull(), F.lit(fixed.TYPE_MESSAGE))


def chunk_block(doc: Column | str, page: Column | str, index: Column | str, text: Column | str) -> Column:
    """Header line and text of one chunk in a prompt (TXT-38)."""
    return F.concat(
        F.lit("[Dok: "), col(doc), F.lit(" | Side "), col(page).cast("string"), F.lit(" | Chunk "),
        col(index).cast("string"), F.lit("]\n"), col(text),
    )


def duration_label(seconds: Column | str) -> Column:
    """'Xs' or 'Xm Ys' (TXT-39)."""
    s = col(seconds).cast("bigint")
    minutes = F.floor(s / 60).cast("string")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(
        F.concat(minutes, F.lit("m "), (s % 60).cast("string"), F.lit("s"))
    )
