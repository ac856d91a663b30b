"""Salvaging JSON from free-text answers, on VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from deedloom import fixed
from deedloom.functions.text import col, distinct_nonempty, strip


def candidates(c: Column | str) -> Column:
    """Texts to try in order: all, fenced blocks, outermost brackets, outermost braces (JSN-01)."""
    t = strip(col(c))
    fenced = F.transform(F.regexp_extract_all(t, F.lit(fixed.FENCED_BLOCK), F.lit(1)), strip)
    outer = F.array(F.regexp_extract(t, r"(?s)\[.*\]", 0), F.regexp_extract(t, r"(?s)\{.*\}", 0))
    return distinct_nonempty(F.concat(F.array(t), fenced, outer))


def object_candidates(c: Column | str) -> Column:
    """The same for an answer that should be one object."""
    t = strip(col(c))
    fenced = F.transform(F.regexp_extract_all(t, F.lit(fixed.FENCED_BLOCK), F.lit(1)), strip)
    return distinct_nonempty(F.concat(F.array(t), fenced, F.array(F.regexp_extract(t, r"(?s)\{.*\}", 0))))


def _wrapped(c: Column) -> Column:
    """The parser stops after the first value; a closing field behind the text shows that it got there."""
    return F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit(',"z":1}')))


def _unwrapped(v: Column) -> Column:
    return F.when(F.try_variant_get(v, "$.z", "int") == 1, F.try_variant_get(v, "$.v", "variant"))


def strict_parse(c: Column) -> Column:
    """Parsed text, null when anything follows the value."""
    return _unwrapped(_wrapped(c))


def payload_list(v: Column) -> Column:
    """The list itself, the first list under a known key, or a single record as a list; else empty (JSN-03)."""
    keyed = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in fixed.ANSWER_LIST_KEYS]
    single = F.lit(False)
    for k in fixed.ANSWER_SINGLE_KEYS:
        single = single | (F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) != "")
    none = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *keyed, F.when(single, F.array(v)), none)


def answer_items(c: Column | str) -> Column:
    """Items of the first candidate that yields any, or of a literal empty list (JSN-02)."""
    # step by step, so that a candidate is parsed once and not for every look into it
    wrapped = F.transform(candidates(c), lambda t: F.struct(t.alias("t"), _wrapped(t).alias("w")))
    parsed = F.transform(wrapped, lambda x: F.struct(x["t"].alias("t"), _unwrapped(x["w"]).alias("v")))
    tried = F.transform(parsed, lambda x: F.struct(x["t"].alias("t"), payload_list(x["v"]).alias("items")))
    good = F.filter(tried, lambda x: (F.size(x["items"]) > 0) | (x["t"] == "[]"))
    return F.coalesce(F.get(good, F.lit(0))["items"], F.array().cast("array<variant>"))


def answer_object(c: Column | str) -> Column:
    """First candidate that is an object, else null (JSN-05)."""
    # an object begins with a brace: nothing else is parsed, and what is parsed is parsed once
    begun = F.filter(object_candidates(c), lambda t: F.startswith(t, F.lit("{")))
    wrapped = F.transform(begun, _wrapped)
    return F.get(F.filter(F.transform(wrapped, _unwrapped), lambda v: v.isNotNull()), F.lit(0))


def field(v: Column, name: str) -> Column:
    """Trimmed text of a field, null when empty (TXT-22)."""
    return F.nullif(strip(F.try_variant_get(v, f"$.{name}", "string")), F.lit(""))


def text_field(v: Column, name: str) -> Column:
    """Text of a field that is a JSON string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def list_field(v: Column, name: str) -> Column:
    """Lower-case texts of a list or of a single string; anything else is empty (TXT-23)."""
    many = F.try_variant_get(v, f"$.{name}", "array<string>")
    cleaned = F.transform(many, lambda x: F.lower(strip(F.coalesce(x, F.lit("none")))))
    one = F.nullif(F.lower(strip(text_field(v, name))), F.lit(""))
    return F.coalesce(F.filter(cleaned, lambda x: x != ""), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def bool_field(v: Column, name: str, default: Column) -> Column:
    """A real JSON boolean, else the default (TXT-26)."""
    is_bool = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "BOOLEAN"
    return F.coalesce(F.when(is_bool, F.try_variant_get(v, f"$.{name}", "boolean")), default)


def quoted(c: Column) -> Column:
    """JSON literal of a text, null for null."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def chat_text(c: Column | str) -> Column:
    """Text of a stored chat response (JSN-08): its first choice as a string or as text parts joined, else its text blocks joined."""
    v = F.try_parse_json(col(c))
    content = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    whole = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    parts = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text"), lambda p: F.try_variant_get(p, "$.text", "string")
    )
    joined = F.array_join(F.filter(texts, lambda x: x != ""), "\n")
    blocks = F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.text", "string"))
    plain = F.array_join(F.filter(blocks, lambda x: x != ""), "\n")
    return F.nullif(strip(F.coalesce(whole, joined, plain)), F.lit(""))
