"""The deterministic scalars as SQL functions, and what gives rows as SQL table functions, kept as expressions so that Catalyst can inline them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from deedloom import fixed
from deedloom.functions.text import LINE_BREAK, STRIP_CHARS


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"trim(BOTH {_q(STRIP_CHARS)} FROM {x})"


def _without(x: str, more: str = "") -> str:
    """The text without blanks (the characters of fixed.BLANK are those that are stripped) and without the characters of `more`; a look-up is faster than a pattern."""
    return f"translate({x}, {_q(STRIP_CHARS + more)}, '')"


def _list(words) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _found(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {_q(pattern)}, {group})"


def _part(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, {_q(pattern)}, {group}), '')"


def _parcel(x: str) -> str:
    t = f"nullif(lower({_without(x)}), '')"
    return f"CASE WHEN rlike({t}, '^[0-9]+[a-z]*$') THEN regexp_replace({t}, '^0+(?=[0-9])', '') ELSE {t} END"


def _padded(pattern: str) -> str:
    d, m, y = (_part("x", pattern, g) for g in (1, 2, 3))
    return f"concat(lpad({d}, 2, '0'), '.', lpad({m}, 2, '0'), '.', {y})"


def _date(x: str) -> str:
    t, head = _strip(x), f"left({_strip(x)}, 10)"
    d, m, y = (_part(t, fixed.TIGHT_DATE, g) for g in (1, 2, 3))
    iso = f"try_to_date(CASE WHEN rlike({head}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {head} END, 'yyyy-MM-dd')"
    return f"coalesce({iso}, try_to_date(concat({y}, '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0')), 'yyyy-MM-dd'))"


_STRIPPED = f"transform(split(x, {_q(LINE_BREAK)}), l -> {_strip('l')})"
_SCOPE = f"filter({_STRIPPED}, l -> contains(lower(l), 'vedr') OR contains(lower(l), 'matr'))"


def page_definitions() -> dict[str, tuple[str, str, str]]:
    """Functions of page texts."""
    near = "left(x, 300)"
    for w in reversed(fixed.RECORD_KEYWORDS):
        at = f"instr(lower(x), {_q(w)})"
        near = f"CASE WHEN {at} > 0 THEN concat('...', substr(x, greatest({at} - 60, 1), 300), '...') ELSE {near} END"
    return {
        "dl_paragraphs": ("x STRING", "ARRAY<STRING>", f"filter(transform(split(x, '\\n{{2,}}'), p -> {_strip('p')}), p -> p <> '')"),
        "dl_date_strings": (
            "x STRING", "ARRAY<STRING>", "array_sort(array_distinct(concat(" + ", ".join(_found("x", p) for p in fixed.DATE_PATTERNS) + ")))",
        ),
        "dl_serial_numbers": ("x STRING", "ARRAY<STRING>", _found("x", fixed.SERIAL_NUMBER)),
        "dl_is_admin_page": ("x STRING", "BOOLEAN", f"rlike(left({_strip('x')}, {fixed.ADMIN_HEADER_CHARS}), {_q(fixed.ADMIN_HEADER)})"),
        "dl_heading": (
            "x STRING", "STRING",
            f"left(try_element_at(filter({_STRIPPED}, l -> length(l) >= 4 AND lower(l) NOT IN {_list(fixed.HEADING_SKIP)}), 1), 160)",
        ),
        "dl_scope_line": ("x STRING", "STRING", f"left(try_element_at({_SCOPE}, 1), 240)"),
        "dl_parcel_refs": (
            "x STRING", "ARRAY<STRING>", f"array_distinct(transform({_found('array_join(' + _SCOPE + ', chr(32))', fixed.PARCEL_TOKEN)}, p -> lower(p)))",
        ),
        "dl_starts_entry": ("x STRING", "BOOLEAN", f"rlike(array_join(slice(split(x, {_q(LINE_BREAK)}), 1, 12), '\\n'), {_q(fixed.DATE_REFERENCE)})"),
        "dl_first_matches": ("x STRING, pattern STRING", "ARRAY<STRING>", "slice(array_distinct(filter(regexp_extract_all(x, pattern, 0), m -> m <> '')), 1, 10)"),
        "dl_keyword_in_context": ("x STRING", "STRING", near),
        "dl_chunk_block": (
            "doc STRING, page INT, idx INT, x STRING", "STRING",
            "concat('[Dok: ', doc, ' | Side ', cast(page AS STRING), ' | Chunk ', cast(idx AS STRING), ']\\n', x)",
        ),
        "dl_parcel_blocks": (
            "x STRING", "ARRAY<STRUCT<matrikelnummer: STRING, landsejerlav: STRING, areal_m2: BIGINT>>",
            f"transform(arrays_zip({', '.join(_found('x', fixed.PARCEL_BLOCK, g) for g in (1, 2, 3))}), z -> named_struct('matrikelnummer', lower(z.`1`), "
            f"'landsejerlav', trim(regexp_replace(z.`0`, {_q('[' + fixed.BLANK + ']+')}, ' ')), 'areal_m2', try_cast(z.`2` AS BIGINT)))",
        ),
    }


def record_definitions() -> dict[str, tuple[str, str, str]]:
    """Functions of fields of records, answers and names."""
    breaks = _q("(?:" + LINE_BREAK + ")$")
    file_part = f"trim(BOTH '._-' FROM regexp_replace(regexp_replace({_strip('x')}, {_q('[' + fixed.BLANK + ']+')}, '_'), '[^0-9A-Za-z._-]+', '-'))"
    dated = _part("x", fixed.DATED_SERIAL, 4)
    full = f"CASE WHEN {dated} IS NOT NULL THEN {_padded(fixed.DATED_SERIAL)} ELSE {_padded(fixed.LOOSE_DATE)} END"
    text = "schema_of_variant(x) = 'STRING'"
    return {
        "dl_distinct_nonempty": ("x ARRAY<STRING>", "ARRAY<STRING>", "array_distinct(filter(x, v -> v IS NOT NULL AND v <> ''))"),
        "dl_parcel_keys": (
            "x ARRAY<STRING>", "ARRAY<STRING>",
            f"coalesce(array_distinct(filter(transform(x, v -> {_parcel('v')}), v -> v IS NOT NULL)), cast(array() AS ARRAY<STRING>))",
        ),
        "dl_text_hash": ("x STRING", "STRING", "sha2(x, 256)"),
        "dl_date_components": (
            "x STRING", "STRUCT<full_date: STRING, lob_suffix: STRING, year: STRING>",
            f"named_struct('full_date', {full}, 'lob_suffix', {dated}, 'year', coalesce(right({full}, 4), {_part('x', fixed.LONE_YEAR, 1)}))",
        ),
        "dl_blank_to_null": ("x STRING", "STRING", f"nullif({_strip('x')}, '')"),
        "dl_int_or": ("x STRING, otherwise INT", "INT", "coalesce(try_cast(x AS INT), otherwise)"),
        "dl_registered_at": ("x STRING, reference STRING", "DATE", f"coalesce({_date('x')}, {_date('reference')})"),
        "dl_text_list": (
            "x VARIANT", "ARRAY<STRING>",
            f"coalesce(filter(transform(try_variant_get(x, '$', 'array<string>'), v -> lower({_strip('coalesce(v, ' + _q('none') + ')')})), v -> v <> ''), "
            f"CASE WHEN {text} AND {_strip('try_variant_get(x, ' + _q('$') + ', ' + _q('string') + ')')} <> '' "
            f"THEN array(lower({_strip('try_variant_get(x, ' + _q('$') + ', ' + _q('string') + ')')})) END, cast(array() AS ARRAY<STRING>))",
        ),
        "dl_flag": ("x VARIANT, otherwise BOOLEAN", "BOOLEAN", "coalesce(CASE WHEN schema_of_variant(x) = 'BOOLEAN' THEN try_variant_get(x, '$', 'boolean') END, otherwise)"),
        "dl_query_words": ("x STRING", "ARRAY<STRING>", f"array_distinct({_found("lower(coalesce(x, ''))", fixed.QUERY_WORD)})"),
        "dl_overlap": (
            "x STRING, words ARRAY<STRING>", "DOUBLE",
            "CASE WHEN size(words) > 0 THEN size(filter(words, w -> contains(lower(x), w))) / size(words) ELSE 0.0D END",
        ),
        "dl_markdown_cell": (
            "x STRING", "STRING",
            f"replace({_strip(f'array_join(split(regexp_replace(coalesce(nullif(x, {_q(str())}), {_q(fixed.EMPTY_CELL)}), {breaks}, {_q(str())}), {_q(LINE_BREAK)}), chr(32))')}, '|', {_q(chr(92) + '|')})",
        ),
        "dl_download_name": ("x STRING", "STRING", f"coalesce(nullif({_strip('regexp_replace(x, ' + _q(r'[<>:' + chr(34) + r'/' + chr(92) * 2 + '|?*]') + ', ' + _q('_') + ')')}, ''), 'fil')"),
        "dl_filename_part": ("x STRING", "STRING", f"coalesce(nullif({file_part}, ''), 'del')"),
        "dl_entity_id": ("prefix STRING, natural_key STRING", "STRING", "concat(prefix, sha2(coalesce(natural_key, ''), 256))"),
        "dl_short_id": ("x STRING", "STRING", f"regexp_replace(x, {_q('^(.*-)?([0-9a-f]{8})[0-9a-f]{56}$')}, '$1$2')"),
        "dl_excerpt": ("x STRING, n INT", "STRING", "left(x, n)"),
        "dl_document_type": (
            "x STRING", "STRING", f"CASE WHEN lower({_strip('x')}) IN {_list([fixed.DEED_TYPE, fixed.REGISTER_TYPE])} THEN lower({_strip('x')}) END",
        ),
        "dl_duration_label": (
            "seconds BIGINT", "STRING",
            "CASE WHEN seconds < 60 THEN concat(cast(seconds AS STRING), 's') ELSE concat(cast(floor(seconds / 60) AS STRING), 'm ', cast(seconds % 60 AS STRING), 's') END",
        ),
    }


def _listed(v: str) -> str:
    """The list that a value is or holds under a known key, or a single record as a list."""
    keyed = ", ".join(f"try_variant_get({v}, '$.{k}', 'array<variant>')" for k in fixed.ANSWER_LIST_KEYS)
    single = " OR ".join(f"coalesce(try_variant_get({v}, '$.{k}', 'string'), '') <> ''" for k in fixed.ANSWER_SINGLE_KEYS)
    return f"coalesce(try_variant_get({v}, '$', 'array<variant>'), {keyed}, CASE WHEN {single} THEN array({v}) END, cast(array() AS ARRAY<VARIANT>))"


def table_definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, columns, query); for use in FROM with LATERAL."""
    fenced = f"transform({_found('t', fixed.FENCED_BLOCK, 1)}, f -> {_strip('f')})"
    tried = f"concat(array(t), {fenced}, array(regexp_extract(t, {_q(r'(?s)\[.*\]')}, 0), regexp_extract(t, {_q(r'(?s)\{.*\}')}, 0)))"
    parsed = "try_parse_json(concat('{\"v\":', c, ',\"z\":1}'))"
    return {
        # paragraphs of a page in order
        "dl_page_paragraphs": ("x STRING", "pos INT, paragraph STRING", f"SELECT p.pos, p.col FROM posexplode({page_definitions()['dl_paragraphs'][2]}) AS p"),
        # parts of a scan
        "dl_page_ranges": (
            "pages INT, per_part INT", "part INT, start_page INT, end_page INT",
            "SELECT r.pos + 1, r.col, least(r.col + per_part - 1, pages) FROM posexplode(CASE WHEN pages >= 1 THEN sequence(1, pages, per_part) END) AS r",
        ),
        # items of the first text within an answer that yields any
        "dl_answer_items": (
            "x STRING", "pos INT, item VARIANT",
            f"SELECT i.pos, i.col FROM (SELECT {_strip('x')} AS t) AS whole, "
            f"LATERAL (SELECT get(filter(transform(array_distinct(filter({tried}, c -> c <> '')), "
            f"c -> named_struct('t', c, 'v', CASE WHEN try_variant_get({parsed}, '$.z', 'int') = 1 THEN try_variant_get({parsed}, '$.v', 'variant') END)), "
            f"s -> s.t = '[]' OR size({_listed('s.v')}) > 0), 0).v AS v) AS first, "
            f"LATERAL posexplode({_listed('v')}) AS i",
        ),
    }


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (arguments, return type, expression)."""
    alnum = "length(regexp_replace(x, " + _q(r"[^\p{L}\p{N}]+") + ", '')) / length(x)"
    head = "left(x, 10)"
    return {
        "dl_clean_text": (
            "x STRING", "STRING",
            _strip(r"regexp_replace(regexp_replace(regexp_replace(x, '\r\n?', '\n'), '\n{3,}', '\n\n'), '[ \t]{2,}|\t', ' ')"),
        ),
        "dl_text_quality": (
            "x STRING", "DOUBLE",
            f"CASE WHEN length(x) > 0 THEN round(least(1.0D, greatest(0.0D, ({alnum} - 0.10D) / 0.40D)), 3) ELSE 0.0D END",
        ),
        "dl_archive_key": ("x STRING", "STRING", f"lower({_without('x', '-')})"),
        "dl_match_key": ("x STRING", "STRING", f"lower({_without('x', '.-')})"),
        "dl_merge_key": ("x STRING", "STRING", "nullif(regexp_replace(lower(x), '[^0-9a-z]+', ''), '')"),
        "dl_parcel_key": ("x STRING", "STRING", _parcel("x")),
        "dl_chunk_id": ("doc STRING, page INT, idx INT", "STRING", "left(sha2(concat_ws(':', doc, cast(page AS STRING), cast(idx AS STRING)), 256), 12)"),
        "dl_has_amt": ("x STRING", "BOOLEAN", f"coalesce(rlike(x, {_q(fixed.AMT_WORD)}), false)"),
        "dl_serial_suffix": ("x STRING", "STRING", f"nullif(regexp_extract(x, {_q(fixed.DATED_SERIAL)}, 4), '')"),
        "dl_sort_date": (
            "x STRING", "DATE",
            f"coalesce(try_to_date(CASE WHEN rlike({head}, {_q(r'^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$')}) THEN {head} END, 'd.M.yyyy'), DATE'9999-12-31')",
        ),
        "dl_has_keywords": (
            "x STRING", "BOOLEAN", " OR ".join(f"contains(lower(x), {_q(w)})" for w in fixed.RECORD_KEYWORDS),
        ),
        "dl_scope_label": (
            "x BOOLEAN", "STRING", f"CASE WHEN x THEN {_q(fixed.SCOPE_YES)} WHEN NOT x THEN {_q(fixed.SCOPE_NO)} ELSE {_q(fixed.SCOPE_MAYBE)} END",
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session (UDF-03)."""
    made = definitions() | page_definitions() | record_definitions()
    for name, (args, returns, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    tables = table_definitions()
    for name, (args, columns, body) in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
    return [*made, *tables]
