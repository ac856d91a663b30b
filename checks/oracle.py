"""DuckDB oracle per registered query, written independently of the Spark code."""

from __future__ import annotations

import re

from checks.base_sql import BLANK, CTES, build, cte, strip
from deedloom import fixed

ORACLES: dict[str, str] = {}
AS_OF = "1999-06-30"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(name: str, select: str, *needs: str) -> None:
    ORACLES[name] = build(select, *needs)


def pkey(x: str) -> str:
    """Parcel normal form."""
    t = f"lower(regexp_replace({x}, '[{BLANK}]+', '', 'g'))"
    return (
        f"CASE WHEN {t} = '' THEN NULL WHEN regexp_full_match({t}, '[0-9]+[a-z]*') THEN "
        f"CASE WHEN ltrim({t}, '0') = '' OR NOT regexp_matches(ltrim({t}, '0'), '^[0-9]') THEN '0' || ltrim({t}, '0') ELSE ltrim({t}, '0') END "
        f"ELSE {t} END"
    )


def pkeys(a: str) -> str:
    return f"list_filter(list_transform({a}, lambda z: {pkey('z')}), lambda q: q IS NOT NULL)"


# ---- report -------------------------------------------------------------------------------------------------
cte(
    "scoped",
    f"""
 SELECT r.*, target_matrikler, available_matrikler,
   CASE WHEN len(t) = 0 OR len(a) = 0 THEN NULL
        WHEN list_has_any(a, t) THEN true
        WHEN len(available_matrikler) > 0 AND NOT list_has_any(a, v) THEN NULL
        ELSE false END AS applies,
   list_filter(list_transform(target_matrikler, lambda x: lower(trim(x))), lambda x: list_contains(a, {pkey('x')})) AS matching
 FROM (SELECT r.*, c.target_matrikler, c.available_matrikler, {pkeys('c.target_matrikler')} AS t,
              {pkeys('r.applies_to_matrikler')} AS a, {pkeys('c.available_matrikler')} AS v
       FROM records r JOIN record_cases c USING (case_id)) r""",
    "records",
    "record_cases",
)
cte(
    "report_inputs",
    f"""
 SELECT * FROM scoped WHERE registered_at IS NULL OR registered_at <= DATE '{AS_OF}'
 QUALIFY date_reference IS NULL OR row_number() OVER (PARTITION BY case_id, date_reference ORDER BY servitut_id) = 1""",
    "scoped",
)
SORT_DATE = "coalesce(try_strptime(left(date_reference, 10), '%d.%m.%Y')::date, DATE '9999-12-31')"
cte(
    "report_entries",
    f"""
 SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {SORT_DATE}, servitut_id) AS nr, date_reference, raw_text,
   CASE WHEN trim(coalesce(summary, '')) = '' THEN CASE WHEN trim(coalesce(raw_text, '')) = '' THEN {lit(fixed.TEXT_NOT_REVIEWED)} ELSE {lit(fixed.TEXT_UNKNOWN)} END ELSE summary END AS description,
   beneficiary, disposition_type AS disposition, legal_type,
   CASE WHEN trim(coalesce(action_note, '')) = '' THEN {lit(fixed.TEXT_LOOK_UP)} ELSE action_note END AS action,
   title, byggeri_markering, coalesce(applies, false) AS relevant_for_project,
   coalesce(regexp_matches(beneficiary, '(?i)(^|[^\\p{{L}}\\p{{N}}_])amt($|[^\\p{{L}}\\p{{N}}_])'), false) AS beneficiary_amt_warning,
   CASE WHEN applies THEN 'Ja' WHEN NOT applies THEN 'Nej' ELSE 'Måske' END AS scope,
   CASE WHEN len(matching) > 0 THEN 'Vedr. matr.nr. ' || array_to_string(matching, ' og ') END AS scope_detail,
   servitut_id
 FROM (SELECT i.*, CASE WHEN d1.document_id IS NULL THEN left(ev1_text, 500) WHEN d2.document_id IS NULL THEN left(ev2_text, 500) END AS raw_text
       FROM report_inputs i
       LEFT JOIN register_documents d1 ON d1.case_id = i.case_id AND d1.document_id = i.ev1_document
       LEFT JOIN register_documents d2 ON d2.case_id = i.case_id AND d2.document_id = i.ev2_document)""",
    "report_inputs",
    "register_documents",
)
oracle("report_fallback", "SELECT * FROM report_entries", "report_entries")
oracle(
    "report_scope_counts",
    """SELECT case_id, count(*) AS entries, count(*) FILTER (scope = 'Ja') AS ja, count(*) FILTER (scope = 'Måske') AS maaske,
  count(*) FILTER (scope = 'Nej') AS nej FROM report_entries GROUP BY case_id""",
    "report_entries",
)
oracle(
    "marking_counts",
    """SELECT case_id, count(*) FILTER (byggeri_markering = 'rød') AS roed, count(*) FILTER (byggeri_markering = 'orange') AS orange,
  count(*) FILTER (byggeri_markering = 'sort') AS sort, count(*) FILTER (applies) AS ja, count(*) FILTER (NOT applies) AS nej,
  count(*) FILTER (applies IS NULL) AS uafklaret, count(*) FILTER (NOT attest_confirmed) AS unconfirmed FROM scoped GROUP BY case_id""",
    "scoped",
)


def cell(x: str) -> str:
    return f"replace(trim(regexp_replace(coalesce(nullif({x}::varchar, ''), '—'), '[\\r\\n]+', ' ', 'g')), '|', '\\|')"


MD_CELLS = " || ' | ' || ".join(
    cell(c)
    for c in ["nr", "date_reference", "title", "byggeri_markering", "description", "beneficiary", "disposition", "legal_type",
              "action", "coalesce(nullif(scope_detail, ''), scope)"]
)
cte("md_rows", f"SELECT case_id, nr + 2 AS line_no, '| | ' || {MD_CELLS} || ' | |' AS line FROM report_entries", "report_entries")
cte(
    "md_table",
    f"""SELECT * FROM md_rows UNION ALL
  SELECT DISTINCT case_id, 1, {lit(fixed.MARKDOWN_HEADER)} FROM report_entries UNION ALL
  SELECT DISTINCT case_id, 2, {lit(fixed.MARKDOWN_DIVIDER)} FROM report_entries""",
    "md_rows",
)
oracle("report_markdown", "SELECT case_id, line_no, line FROM md_table", "md_table")
oracle(
    "report_edit_roundtrip",
    """SELECT case_id, nr, nullif(trim(date_reference), '') AS date_reference, nullif(trim(raw_text), '') AS raw_text,
  nullif(trim(description), '') AS description, nullif(trim(beneficiary), '') AS beneficiary,
  nullif(trim(disposition), '') AS disposition, nullif(trim(legal_type), '') AS legal_type, nullif(trim(action), '') AS action,
  CASE WHEN old % 3 = 0 THEN NULL ELSE nullif(trim(title), '') END AS title, nullif(trim(byggeri_markering), '') AS byggeri_markering,
  relevant_for_project, beneficiary_amt_warning, scope, scope_detail,
  CASE WHEN old % 4 = 0 THEN 'manual-row-' || nr::varchar ELSE servitut_id END AS servitut_id, true AS manually_edited
 FROM (SELECT * EXCLUDE nr, nr AS old, row_number() OVER (PARTITION BY case_id ORDER BY
         CASE WHEN nr % 7 = 0 OR nr % 5 = 0 THEN 10000 ELSE 9000 - nr END, nr) AS nr FROM report_entries)""",
    "report_entries",
)

# ---- pages --------------------------------------------------------------------------------------------------
oracle("page_clean", "SELECT case_id, document_id, page_number, text FROM clean_pages", "clean_pages")
oracle(
    "page_quality",
    "SELECT document_id, page_number, confidence, CASE WHEN confidence >= 0.7 THEN 'God' WHEN confidence > 0 THEN 'Lav' ELSE 'Tom' END AS band FROM quality_pages",
    "quality_pages",
)


def summary(keys: str, cut: float) -> str:
    return f"""SELECT {keys}, count(*) AS pages, count(*) FILTER (confidence = 0) AS blank, count(*) FILTER (confidence > 0 AND confidence < {cut}) AS low,
  count(*) FILTER (confidence >= {cut}) AS ok FROM quality_pages GROUP BY {keys}"""


oracle("page_summary", summary("case_id, document_id", 0.4), "quality_pages")
oracle("page_bands", summary("case_id", 0.7), "quality_pages")
oracle("low_pages", "SELECT document_id, page_number, confidence FROM quality_pages WHERE confidence > 0 AND confidence < 0.7", "quality_pages")

cte(
    "page_paras",
    f"""
 SELECT case_id, document_id, page_number, text,
   list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: {strip('x')}), lambda x: x <> '') AS ps
 FROM clean_pages""",
    "clean_pages",
)
oracle(
    "page_paragraphs",
    "SELECT document_id, page_number, unnest(ps) AS paragraph, generate_subscripts(ps, 1) - 1 AS pos FROM page_paras",
    "page_paras",
)
ADMIN = "regexp_matches(substr(%s, 1, 80), '(?i)^dss\\s+\\d+.{0,50}bulk\\s+(sort|hvid)\\b')" % strip("text")
cte(
    "packed",
    f"""packed(case_id, document_id, page_number, ps, i, cur, cs, out_text, out_cs) AS (
 SELECT case_id, document_id, page_number, ps, 1, ps[1], 0::bigint, NULL::varchar, NULL::bigint FROM page_paras
 WHERE text <> '' AND len(ps) > 0 AND NOT {ADMIN}
 UNION ALL
 SELECT case_id, document_id, page_number, ps, i + 1,
   CASE WHEN length(cur) + length(ps[i + 1]) + 2 > 2000 THEN right(cur, 200) || chr(10) || chr(10) || ps[i + 1]
        ELSE {strip("cur || chr(10) || chr(10) || ps[i + 1]")} END,
   CASE WHEN length(cur) + length(ps[i + 1]) + 2 > 2000 THEN length(cur) - least(200, length(cur)) ELSE cs END,
   CASE WHEN length(cur) + length(ps[i + 1]) + 2 > 2000 THEN cur END,
   CASE WHEN length(cur) + length(ps[i + 1]) + 2 > 2000 THEN cs END
 FROM packed WHERE i < len(ps))""",
    "page_paras",
)
cte(
    "chunks",
    """
 SELECT case_id, document_id, page_number AS page, idx::int AS chunk_index, t AS text, cs::int AS char_start, (cs + length(t))::int AS char_end,
   substr(sha256(document_id || ':' || page_number::varchar || ':' || idx::varchar), 1, 12) AS chunk_id
 FROM (SELECT *, row_number() OVER (PARTITION BY case_id, document_id ORDER BY page_number, i, last) - 1 AS idx FROM (
   SELECT case_id, document_id, page_number, i, 0 AS last, out_text AS t, out_cs AS cs FROM packed WHERE out_text IS NOT NULL
   UNION ALL SELECT case_id, document_id, page_number, i, 1, cur, cs FROM packed WHERE i = len(ps)))""",
    "packed",
)
oracle("chunk_pages", "SELECT * FROM chunks", "chunks")
KW = " OR ".join(f"contains(lower(text), {lit(k)})" for k in fixed.RECORD_KEYWORDS)
oracle("keyword_prescreen", f"SELECT document_id, chunk_index, chunk_id FROM chunks WHERE {KW}", "chunks")
KWIC = " ".join(
    f"WHEN contains(lower(text), {lit(k)}) THEN '...' || substr(text, greatest(instr(lower(text), {lit(k)}) - 60, 1), 300) || '...'"
    for k in fixed.RECORD_KEYWORDS
)
oracle(
    "keyword_in_context",
    f"SELECT document_id, page_number, CASE {KWIC} ELSE left(text, 300) END AS snippet FROM clean_pages",
    "clean_pages",
)
W = r"[\p{L}\p{N}_]"
oracle(
    "date_references",
    rf"""SELECT DISTINCT document_id, page_number, unnest(regexp_extract_all(text, '\d{{2}}\.\d{{2}}\.\d{{4}}') || regexp_extract_all(text, '\d{{4}}-\d{{2}}-\d{{2}}')
  || regexp_extract_all(text, '\d{{2}}/\d{{2}}-\d{{4}}') || regexp_extract_all(text, '\d{{1,2}}\.\s*{W}+\s*\d{{4}}')) AS date_string FROM clean_pages""",
    "clean_pages",
)
DATE_REF = r"\b\d{2}\.\d{2}\.\d{4}-[0-9A-Za-z./-]+\b"


def first10(p: str) -> str:
    # distinct in order: keep an element when its first position is its own
    a = f"regexp_extract_all(text, '{p}')"
    return f"array_to_string(list_slice(list_filter({a}, lambda x, i: list_position({a}, x) = i), 1, 10), '|')"


oracle(
    "archive_numbers",
    rf"""SELECT document_id, page_number, {first10(r'\b(?:\d+\s*[A-ZÆØÅ]\s*-?\s*\d+|[A-ZÆØÅ]-\d+|\d+\s*[A-ZÆØÅ]\s*\d+)\b')} AS archive_numbers,
  {first10(DATE_REF)} AS date_refs, array_to_string(regexp_extract_all(text, '\d{{6,}}-\d+'), '|') AS serials,
  regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 12), chr(10)), '{DATE_REF}') AS starts_entry FROM clean_pages""",
    "clean_pages",
)
SCOPE = "list_filter(list_transform(string_split(text, chr(10)), lambda x: %s), lambda x: contains(lower(x), 'vedr') OR contains(lower(x), 'matr'))" % strip("x")
PARCEL = r"(?i)\b\d+[a-zæøå]{0,3}\b"
oracle(
    "parcel_refs",
    f"""SELECT document_id, page_number, left(list_filter(ls, lambda x: length(x) >= 4 AND lower(x) NOT IN ('tinglysningsattest', 'servitutter'))[1], 160) AS heading,
  left(sc[1], 240) AS scope_line, array_to_string(list_filter(pr, lambda x, i: list_position(pr, x) = i), ',') AS parcels
 FROM (SELECT *, list_transform(regexp_extract_all(array_to_string(sc, ' '), '{PARCEL}'), lambda x: lower(x)) AS pr FROM (
   SELECT document_id, page_number, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) AS ls, {SCOPE} AS sc FROM clean_pages))""",
    "clean_pages",
)
oracle("admin_pages", f"SELECT document_id, page_number FROM clean_pages WHERE {ADMIN}", "clean_pages")
RM = " OR ".join(f"contains(t, {lit(m)})" for m in fixed.REGISTER_TEXT_MARKERS)
DM = " + ".join(f"contains(t, {lit(m)})::int" for m in fixed.DEED_TEXT_MARKERS)
NM = " OR ".join(f"contains(lower(filename), {lit(m)})" for m in fixed.REGISTER_FILENAME_MARKERS)
cte(
    "heads",
    """SELECT document_id, lower(string_agg(text, chr(10) ORDER BY page_number)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS rn
    FROM clean_pages) WHERE rn <= 2 GROUP BY document_id""",
    "clean_pages",
)
TYPED = f"""CASE WHEN {{asked}} IN ('akt', 'tinglysningsattest') THEN {{asked}} WHEN {RM} THEN 'tinglysningsattest' WHEN {DM} >= 2 THEN 'akt'
  WHEN {NM} THEN 'tinglysningsattest' ELSE 'akt' END"""
oracle(
    "classify_documents",
    f"""SELECT d.document_id, filename, {TYPED.format(asked="CASE WHEN pos % 33 <> 1 THEN lower(trim(requested_type)) END")} AS document_type,
  CASE WHEN pos % 33 = 1 THEN {lit(fixed.TYPE_MESSAGE)} END AS type_error FROM documents_meta d LEFT JOIN heads h USING (document_id)""",
    "documents_meta",
    "heads",
)
oracle(
    "page_batches",
    "SELECT document_id, (page_number - 1) // 3 + 1 AS batch, min(page_number) AS first_page, max(page_number) AS last_page FROM raw_pages GROUP BY 1, 2",
    "raw_pages",
)
oracle(
    "document_counts",
    f"""SELECT document_id, document_type, 'ocr_done' AS parse_status, pages AS page_count, coalesce(n, 0) AS chunk_count, blank AS ocr_blank_pages, low AS ocr_low_conf_pages,
  pages::varchar || ' sider, ' || coalesce(n, 0)::varchar || ' chunks (' || CASE WHEN pages > 4 THEN 'genbrugte ocr.pdf, OCR-sider' WHEN pages > 2 THEN 'genbrugte ocr.pdf' ELSE 'fuld OCR-kørsel' END || ')' AS message
 FROM documents_meta LEFT JOIN (SELECT document_id, count(*) AS pages, count(*) FILTER (confidence = 0) AS blank, count(*) FILTER (confidence > 0 AND confidence < 0.4) AS low FROM quality_pages GROUP BY 1) USING (document_id)
 LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) USING (document_id)""",
    "documents_meta",
    "quality_pages",
    "chunks",
)

# ---- signals, scoring, selection ------------------------------------------------------------------------------
STOP = "(" + ", ".join(lit(w) for w in fixed.TITLE_STOPWORDS) + ")"


def akey(x: str) -> str:
    return f"lower(regexp_replace({x}, '[{BLANK}\\-]+', '', 'g'))"


def mkey(x: str) -> str:
    return f"lower(regexp_replace({x}, '[{BLANK}.\\-]+', '', 'g'))"


def grp(x: str, p: str, g: int) -> str:
    return f"nullif(regexp_extract({x}, '{p}', {g}), '')"


SERIAL_RE = r"(\d{1,2})\.(\d{1,2})\.(\d{4})-(\d+(?:-\d+)+)"
LOOSE_RE = r"(\d{1,2})\s*[./]\s*(\d{1,2})\s*[./]\s*(\d{4})"


def lob(x: str) -> str:
    return grp(x, SERIAL_RE, 4)


def full(x: str) -> str:
    def f(p: str) -> str:
        return f"lpad({grp(x, p, 1)}, 2, '0') || '.' || lpad({grp(x, p, 2)}, 2, '0') || '.' || {grp(x, p, 3)}"

    return f"CASE WHEN {lob(x)} IS NOT NULL THEN {f(SERIAL_RE)} ELSE {f(LOOSE_RE)} END"


def year(x: str) -> str:
    lone = grp(x, r"\b(1[89]\d{2}|20\d{2})\b", 1)
    return f"coalesce(right({full(x)}, 4), {lone})"


cte(
    "signals",
    rf"""
 SELECT DISTINCT * FROM (
 SELECT case_id, ord, servitut_id, date_reference, title, akt_nr, 'akt_nr' AS signal_type, {akey('akt_nr')} AS normalized_value, akt_nr AS display_value FROM canonicals WHERE akt_nr <> ''
 UNION ALL SELECT case_id, ord, servitut_id, date_reference, title, akt_nr, 'date_ref', {mkey('date_reference')}, date_reference FROM canonicals WHERE date_reference <> ''
 UNION ALL SELECT case_id, ord, servitut_id, date_reference, title, akt_nr, 'lob_suffix', {mkey(lob('date_reference'))}, {lob('date_reference')} FROM canonicals WHERE {lob('date_reference')} IS NOT NULL
 UNION ALL SELECT case_id, ord, servitut_id, date_reference, title, akt_nr, 'matrikel', lower(m), lower(m) FROM (SELECT *, unnest(applies_to_matrikler) AS m FROM canonicals)
 UNION ALL SELECT case_id, ord, servitut_id, date_reference, title, akt_nr, 'title_word', w, w FROM (SELECT *, regexp_replace(unnest(string_split_regex(lower(title), '[{BLANK}]+')), '[^\p{{L}}\p{{N}}_]', '', 'g') AS w FROM canonicals)
   WHERE length(w) >= 6 AND w NOT IN {STOP}) WHERE normalized_value <> ''""",
    "canonicals",
)
RULES = ", ".join(f"({i}, {lit(t)}, {lit(m[0])}, {m[1]}, {lit(m[2])})" for i, (t, m) in enumerate(fixed.SCORING_RULES.items()))
cte("rules", f"SELECT * FROM (VALUES {RULES}) v(rule_order, signal_type, label, weight, description)")
cte(
    "catalog",
    """
 SELECT case_id, signal_type, normalized_value, signal_type || ':' || normalized_value AS signal_key, label, weight, description, rule_order,
   list_sort(list(DISTINCT display_value)) AS display_values,
   count(DISTINCT (coalesce(date_reference, '—'), coalesce(title, '—'), coalesce(akt_nr, '—'))) AS canonical_refs
 FROM signals JOIN rules USING (signal_type) GROUP BY ALL""",
    "signals",
    "rules",
)
oracle(
    "scoring_rules",
    """SELECT rule_order, signal_type, label, weight, description, 2 AS minimum_score, 1 AS context_window, 12 AS max_candidate_chunks, 16000 AS max_candidate_chars,
  (SELECT count(*) FROM signals s WHERE s.signal_type = rules.signal_type) AS signals FROM rules""",
    "rules",
    "signals",
)
oracle(
    "signal_catalog",
    "SELECT * EXCLUDE (rule_order, display_values), array_to_string(display_values, '|') AS display_values FROM catalog",
    "catalog",
)
oracle(
    "signal_groups",
    """SELECT c.case_id, r.signal_type, r.label, r.weight, r.description, count(k.signal_key) AS count,
  coalesce(array_to_string(list_slice(list(array_to_string(k.display_values, ', ') ORDER BY k.normalized_value) FILTER (k.signal_key IS NOT NULL), 1, 5), ' | '), '—') AS examples
 FROM (SELECT DISTINCT case_id FROM documents_meta) c CROSS JOIN rules r LEFT JOIN catalog k ON k.case_id = c.case_id AND k.signal_type = r.signal_type GROUP BY 1, 2, 3, 4, 5""",
    "documents_meta",
    "rules",
    "catalog",
)
oracle(
    "canonical_signals",
    """SELECT c.case_id, c.servitut_id, coalesce(c.date_reference, '—') AS date_reference, coalesce(nullif(c.title, ''), '—') AS title, coalesce(c.akt_nr, '—') AS akt_nr,
  coalesce(c.raw_scope_text, '—') AS raw_scope_text, array_to_string(c.applies_to_matrikler, ', ') AS applies_to_matrikler, coalesce(x, '—') AS derived_signals
 FROM canonicals c LEFT JOIN (SELECT s.servitut_id, string_agg(k.label || ' (' || k.weight::varchar || '): ' || array_to_string(k.display_values, ', '), ' | ' ORDER BY rule_order, normalized_value) AS x
   FROM (SELECT DISTINCT case_id, servitut_id, signal_type, normalized_value FROM signals) s JOIN catalog k USING (case_id, signal_type, normalized_value) GROUP BY 1) USING (servitut_id)""",
    "canonicals",
    "signals",
    "catalog",
)
cte(
    "matches",
    f"""
 SELECT c.case_id, c.document_id, c.chunk_index, k.signal_type, k.normalized_value, k.signal_key, k.weight, k.label, k.display_values, k.rule_order
 FROM (SELECT *, {mkey('text')} AS n, lower(text) AS l FROM chunks) c JOIN catalog k ON k.case_id = c.case_id AND
   CASE WHEN k.signal_type IN ('matrikel', 'title_word') THEN contains(l, k.normalized_value) ELSE contains(n, k.normalized_value) END""",
    "chunks",
    "catalog",
)
oracle("signal_matches", "SELECT case_id, document_id, chunk_index, signal_type, normalized_value, weight FROM matches", "matches")
cte(
    "scored",
    """
 SELECT c.case_id, c.document_id, c.chunk_index, c.chunk_id, c.page, length(c.text) AS text_length, coalesce(score, 0) AS score, coalesce(reasons, '') AS reasons
 FROM chunks c LEFT JOIN (SELECT case_id, document_id, chunk_index, sum(weight) AS score, string_agg(signal_key, ',' ORDER BY signal_key) AS reasons FROM matches GROUP BY 1, 2, 3) USING (case_id, document_id, chunk_index)""",
    "chunks",
    "matches",
)
oracle("score_chunks", "SELECT * FROM scored", "scored")
oracle(
    "signal_provenance",
    """SELECT case_id, document_id, chunk_index, string_agg(label || ' (' || weight::varchar || '): ' || array_to_string(display_values, ', ') || ' → ' || refs, ' | ' ORDER BY rule_order, normalized_value) AS matched_signals
 FROM matches JOIN (SELECT case_id, signal_type || ':' || normalized_value AS signal_key, string_agg(r, '; ' ORDER BY o, r) AS refs FROM (
     SELECT case_id, signal_type, normalized_value, coalesce(date_reference, '—') || ' — ' || coalesce(title, '—') AS r, min(ord) AS o,
     row_number() OVER (PARTITION BY case_id, signal_type, normalized_value ORDER BY min(ord), coalesce(date_reference, '—') || ' — ' || coalesce(title, '—')) AS rn
     FROM signals GROUP BY 1, 2, 3, 4) WHERE rn <= 2 GROUP BY 1, 2) USING (case_id, signal_key) GROUP BY 1, 2, 3""",
    "matches",
    "signals",
)
cte(
    "selection",
    """
 SELECT *, coalesce(rank <= 12 AND taken <= 16000, false) AS selected, coalesce(rank > 12, false) AS cand_excl, coalesce(rank <= 12 AND taken > 16000, false) AS char_excl
 FROM (SELECT *, CASE WHEN rank <= 12 THEN sum(text_length) OVER (PARTITION BY case_id, document_id, ctx AND rank <= 12 ORDER BY chunk_index) END AS taken FROM (
   SELECT *, CASE WHEN ctx THEN row_number() OVER (PARTITION BY case_id, document_id, ctx ORDER BY score DESC, chunk_index) END AS rank FROM (
     SELECT *, score >= 2 AS hit, prev >= 2 AS hp, nxt >= 2 AS hn, greatest(score, prev, nxt) >= 2 AS ctx FROM (
       SELECT *, coalesce(lag(score) OVER w, 0) AS prev, coalesce(lead(score) OVER w, 0) AS nxt, lag(page) OVER w AS pp, lead(page) OVER w AS pn
       FROM scored WINDOW w AS (PARTITION BY case_id, document_id ORDER BY chunk_index)))))""",
    "scored",
)
oracle("candidate_selection", "SELECT document_id, chunk_index, score, rank, text_length, hit FROM selection WHERE selected", "selection")
LABELS = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.SELECTION_LABELS.items())
REASONS = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.SELECTION_REASONS.items())
oracle(
    "selection_trace",
    f"""SELECT case_id, document_id, chunk_index, chunk_id, page, score, rank, text_length, selected, st AS selection_state, CASE st {LABELS} END AS selection_label,
  CASE WHEN st = 'selected_context' THEN {lit(fixed.SELECTION_NEIGHBOUR_PREFIX)} || concat_ws(', ', CASE WHEN hp THEN 'side ' || pp::varchar END, CASE WHEN hn THEN 'side ' || pn::varchar END) || '.'
   ELSE CASE st {REASONS} ELSE '' END END AS selection_reason
 FROM (SELECT *, CASE WHEN selected AND hit THEN 'selected_hit' WHEN selected THEN 'selected_context' WHEN char_excl THEN 'excluded_char_cap' WHEN cand_excl THEN 'excluded_candidate_cap'
    WHEN score > 0 THEN 'below_threshold' ELSE 'hidden' END AS st FROM selection) WHERE score > 0 OR selected OR cand_excl OR char_excl""",
    "selection",
)
cte(
    "sel_summary",
    """
 SELECT case_id, document_id, filename, count(*) AS total_chunks, count(*) FILTER (selected) AS candidate_count, coalesce(sum(text_length) FILTER (selected), 0) AS candidate_chars,
  max(score) AS max_score, count(*) FILTER (hit) AS hit_chunks, count(*) FILTER (selected AND hit) AS selected_hit_chunks, count(*) FILTER (selected AND NOT hit) AS selected_context_chunks,
  count(*) FILTER (score > 0 AND score < 2 AND NOT selected) AS below_threshold_chunks, count(*) FILTER (cand_excl) AS candidate_cap_excluded_chunks,
  count(*) FILTER (char_excl) AS char_cap_excluded_chunks, count(*) FILTER (score > 0 OR selected OR cand_excl OR char_excl) AS visible_chunks, count(*) FILTER (selected) = 0 AS skipped
 FROM selection JOIN documents_meta USING (case_id, document_id) WHERE document_type = 'akt' GROUP BY 1, 2, 3""",
    "selection",
    "documents_meta",
)
oracle("selection_summary", "SELECT * FROM sel_summary", "sel_summary")
oracle(
    "scoring_totals",
    """SELECT case_id, count(*) FILTER (NOT skipped) AS sent_documents, count(*) FILTER (skipped) AS skipped_documents, sum(candidate_count) AS candidates,
  sum(candidate_chars) AS candidate_chars, sum(selected_context_chunks) AS context_chunks FROM sel_summary GROUP BY 1""",
    "sel_summary",
)

# ---- linkage --------------------------------------------------------------------------------------------------
COMP = f"{full('date_reference')} AS f, {lob('date_reference')} AS l, {year('date_reference')} AS y"
cte(
    "canon_c",
    f"""SELECT *, coalesce(nullif(date_reference, ''), 'id:' || servitut_id) AS ck, nullif({akey('akt_nr')}, '') AS ak, {COMP} FROM canonicals""",
    "canonicals",
)
cte("items_c", f"SELECT *, nullif({akey('akt_nr')}, '') AS ak, {COMP} FROM deed_items", "deed_items")
cte("years", "SELECT case_id, y AS year, count(*) AS records FROM canon_c WHERE y IS NOT NULL GROUP BY 1, 2", "canon_c")
cte("akts", "SELECT case_id, ak AS akt_key, count(*) AS records, min(ord) AS first_ord FROM canon_c WHERE ak IS NOT NULL GROUP BY 1, 2", "canon_c")
oracle(
    "date_components",
    f"""SELECT servitut_id, date_reference, f AS full_date, l AS lob_suffix, y AS year FROM canon_c
  UNION ALL SELECT item_id, date_reference, f, l, y FROM items_c""",
    "canon_c",
    "items_c",
)


def dmy(x: str) -> str:
    p = r"(\d{1,2})[./](\d{1,2})[./](\d{4})"
    return f"try_cast({grp(x, p, 3)} || '-' || lpad({grp(x, p, 2)}, 2, '0') || '-' || lpad({grp(x, p, 1)}, 2, '0') AS date)"


oracle(
    "registered_at",
    f"""SELECT item_id, coalesce({dmy('title')}, {dmy('date_reference')}) AS registered_at,
  coalesce(CASE WHEN regexp_full_match(left(date_reference, 10), '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN try_strptime(left(date_reference, 10), '%d.%m.%Y')::date END, DATE '9999-12-31') AS sort_date FROM deed_items""",
    "deed_items",
)
oracle(
    "normalize_keys",
    f"""SELECT servitut_id, {akey('akt_nr')} AS akt_key, {mkey('date_reference')} AS date_key,
  nullif(regexp_replace(lower(title), '[^0-9a-z]+', '', 'g'), '') AS title_key, nullif(trim(action_note), '') AS note FROM records""",
    "records",
)
oracle("canonical_years", "SELECT * FROM years", "years")
oracle("archive_groups", "SELECT * FROM akts", "akts")
# the pairwise rule, applied to all pairs of a case
SAME = """CASE WHEN c.y IS NULL OR i.y IS NULL THEN false WHEN c.l IS NOT NULL AND i.l IS NOT NULL THEN c.l = i.l
  WHEN c.f IS NOT NULL AND i.f IS NOT NULL THEN c.f = i.f ELSE c.y = i.y AND n.records = 1 END"""
cte(
    "pairs",
    f"""SELECT c.case_id, c.ord AS c_ord, c.ck, i.ord AS i_ord, i.confidence, i.ak AS i_ak FROM canon_c c JOIN items_c i ON c.case_id = i.case_id
  LEFT JOIN years n ON n.case_id = c.case_id AND n.year = c.y WHERE {SAME}""",
    "canon_c",
    "items_c",
    "years",
)
cte(
    "counts",
    """SELECT c.case_id, c.ord, c.servitut_id, count(*) AS matches, arg_min(p.i_ord, (-p.confidence, p.i_ord)) AS deed_ord
  FROM pairs p JOIN canon_c c ON c.case_id = p.case_id AND c.ord = p.c_ord GROUP BY 1, 2, 3""",
    "pairs",
    "canon_c",
)
oracle("match_counts", "SELECT * FROM counts", "counts")
cte(
    "resolved",
    """
 SELECT i.*, coalesce(one.first_ord, ad.o, af.o, d.o, fz.o) AS matched_ord,
   CASE WHEN coalesce(one.first_ord, ad.o, af.o) IS NOT NULL THEN 1 WHEN d.o IS NOT NULL THEN 2 WHEN fz.o IS NOT NULL THEN 3 END AS match_priority
 FROM items_c i
 LEFT JOIN (SELECT case_id, akt_key, (SELECT min(o.ord) FROM canon_c o WHERE o.case_id = c.case_id AND o.ck = c.ck) AS first_ord
            FROM akts a JOIN canon_c c USING (case_id) WHERE a.records = 1 AND c.ak = a.akt_key) one ON one.case_id = i.case_id AND one.akt_key = i.ak
 LEFT JOIN (SELECT c.case_id, c.ak, c.date_reference, min(k.o) AS o FROM canon_c c JOIN akts a ON a.case_id = c.case_id AND a.akt_key = c.ak AND a.records > 1
            JOIN (SELECT case_id, ck, min(ord) AS o FROM canon_c GROUP BY 1, 2) k ON k.case_id = c.case_id AND k.ck = c.ck
            WHERE c.date_reference <> '' GROUP BY 1, 2, 3) ad ON ad.case_id = i.case_id AND ad.ak = i.ak AND ad.date_reference = i.date_reference
 LEFT JOIN (SELECT p.case_id, p.i_ord, min(p.c_ord) AS o FROM pairs p
            JOIN (SELECT DISTINCT c.case_id, c.ak, c.ck FROM canon_c c JOIN akts a ON a.case_id = c.case_id AND a.akt_key = c.ak AND a.records > 1) m
              ON m.case_id = p.case_id AND m.ak = p.i_ak AND m.ck = p.ck GROUP BY 1, 2) af ON af.case_id = i.case_id AND af.i_ord = i.ord
 LEFT JOIN (SELECT case_id, date_reference, min(ord) AS o FROM canon_c WHERE date_reference <> '' GROUP BY 1, 2) d ON d.case_id = i.case_id AND d.date_reference = i.date_reference
 LEFT JOIN (SELECT case_id, i_ord, min(c_ord) AS o FROM pairs GROUP BY 1, 2) fz ON fz.case_id = i.case_id AND fz.i_ord = i.ord""",
    "items_c",
    "canon_c",
    "akts",
    "pairs",
)
oracle("resolve_keys", "SELECT case_id, item_id, matched_ord, match_priority FROM resolved", "resolved")
CONF = "coalesce(nullif(confidence, 0), 0.5)"
cte(
    "best",
    f"""SELECT case_id, matched_ord, arg_min(ord, (match_priority, -{CONF}, ord)) AS item_ord, min(match_priority) AS match_priority
  FROM resolved WHERE matched_ord IS NOT NULL GROUP BY 1, 2""",
    "resolved",
)
oracle("best_items", "SELECT * FROM best", "best")
cte(
    "orphan_rows",
    f"""SELECT * REPLACE ({CONF} AS confidence), coalesce(ak, nullif(date_reference, '')) AS orphan_key FROM resolved
  WHERE matched_ord IS NULL AND coalesce(ak, nullif(date_reference, '')) IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY case_id, coalesce(ak, nullif(date_reference, '')) ORDER BY {CONF} DESC, ord) = 1""",
    "resolved",
)
oracle("orphans", "SELECT case_id, ord, orphan_key, confidence, false AS attest_confirmed FROM orphan_rows", "orphan_rows")
ENRICH = """c.case_id, c.ord, coalesce(i.document_id, c.source_document) AS source_document, c.date_reference, coalesce(i.akt_nr, c.akt_nr) AS akt_nr, c.title,
  coalesce(i.summary, c.summary) AS summary, coalesce(i.beneficiary, c.beneficiary) AS beneficiary, i.disposition_type, i.legal_type, i.action_note, c.raw_scope_text,
  greatest(c.confidence, {conf}) AS confidence,
  array_to_string(CASE WHEN len(c.applies_to_matrikler) = 0 AND c.raw_scope_text IS NULL AND len(i.applies_to_matrikler) > 0 THEN i.applies_to_matrikler ELSE c.applies_to_matrikler END, ',') AS applies"""
oracle(
    "merge_best",
    f"""SELECT {ENRICH.format(conf='i.confidence')}, CASE WHEN i.ord IS NULL THEN CASE WHEN c.ord % 3 > 0 THEN 'attest' END
   WHEN len(c.applies_to_matrikler) = 0 AND c.raw_scope_text IS NULL THEN 'akt' ELSE 'attest' END AS scope_source,
   coalesce(i.ord % 7 = 0, false) AS construction_relevance FROM canon_c c LEFT JOIN counts m ON m.case_id = c.case_id AND m.ord = c.ord
  LEFT JOIN items_c i ON i.case_id = c.case_id AND i.ord = m.deed_ord""",
    "canon_c",
    "counts",
    "items_c",
)
oracle(
    "discarded_deeds",
    "SELECT case_id, item_id FROM items_c i WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.case_id = i.case_id AND p.i_ord = i.ord)",
    "items_c",
    "pairs",
)
oracle(
    "enrich_canonical",
    f"""SELECT {ENRICH.format(conf='CASE WHEN i.ord IS NOT NULL THEN coalesce(nullif(i.confidence, 0), 0.5) END')}, true AS attest_confirmed
  FROM (SELECT *, min(ord) OVER (PARTITION BY case_id, ck) AS first FROM canon_c) c LEFT JOIN best b ON b.case_id = c.case_id AND b.matched_ord = c.first
  LEFT JOIN items_c i ON i.case_id = c.case_id AND i.ord = b.item_ord
  UNION ALL SELECT case_id, ord, document_id, date_reference, akt_nr, title, summary, beneficiary, disposition_type, legal_type, action_note, NULL, confidence,
   array_to_string(applies_to_matrikler, ','), false FROM orphan_rows""",
    "canon_c",
    "best",
    "items_c",
    "orphan_rows",
)

# ---- register segments ----------------------------------------------------------------------------------------
cte(
    "seg_pages",
    rf"""
 SELECT *, row_number() OVER (PARTITION BY case_id, document_id ORDER BY page) AS p, length(text) AS ch,
   regexp_matches(array_to_string(list_slice(string_split(text, chr(10)), 1, 12), chr(10)), '{DATE_REF}') AS st
 FROM (SELECT case_id, document_id, page, coalesce(string_agg({strip('text')}, chr(10) ORDER BY chunk_index) FILTER ({strip('text')} <> ''), '') AS text,
   min(chunk_index) AS c0, max(chunk_index) AS c1 FROM chunks GROUP BY 1, 2, 3)""",
    "chunks",
)
cte(
    "seg_steps",
    """
 SELECT case_id, document_id, p, total, CASE WHEN k >= 4 AND s4 THEN 4 WHEN k >= 3 AND s3 THEN 3 WHEN k >= 2 AND s2 THEN 2 WHEN s1 THEN 1 ELSE k END AS m
 FROM (SELECT *, CASE WHEN a2 <= 9000 THEN CASE WHEN a3 <= 9000 THEN CASE WHEN a4 <= 9000 THEN 4 ELSE 3 END ELSE 2 END ELSE 1 END AS k FROM (
   SELECT case_id, document_id, p, count(*) OVER (PARTITION BY case_id, document_id) AS total, ch + lead(ch, 1) OVER w AS a2, ch + lead(ch, 1) OVER w + lead(ch, 2) OVER w AS a3,
    ch + lead(ch, 1) OVER w + lead(ch, 2) OVER w + lead(ch, 3) OVER w AS a4,
    coalesce(lead(st, 1) OVER w, false) AS s1, coalesce(lead(st, 2) OVER w, false) AS s2, coalesce(lead(st, 3) OVER w, false) AS s3, coalesce(lead(st, 4) OVER w, false) AS s4
   FROM seg_pages WINDOW w AS (PARTITION BY case_id, document_id ORDER BY p)))""",
    "seg_pages",
)
cte(
    "seg_walk",
    """seg_walk(case_id, document_id, p, m, total, idx) AS (
 SELECT case_id, document_id, p, m, total, 0 FROM seg_steps WHERE p = 1
 UNION ALL SELECT s.case_id, s.document_id, s.p, s.m, s.total, idx + 1 FROM seg_walk w JOIN seg_steps s ON s.case_id = w.case_id AND s.document_id = w.document_id
   AND s.p = w.p + greatest(1, w.m - 1) WHERE w.p + w.m <= w.total)""",
    "seg_steps",
)
cte(
    "segments",
    """
 SELECT w.case_id, w.document_id, w.document_id || '-segment-' || lpad(idx::varchar, 4, '0') AS segment_id, idx AS segment_index, list(g.page ORDER BY g.page) AS page_numbers,
  min(c0) AS chunk_start_index, max(c1) AS chunk_end_index, string_agg('[Side ' || g.page::varchar || ']' || chr(10) || g.text, chr(10) || chr(10) ORDER BY g.page) AS text
 FROM seg_walk w JOIN seg_pages g ON g.case_id = w.case_id AND g.document_id = w.document_id AND g.p BETWEEN w.p AND w.p + w.m - 1 GROUP BY w.case_id, w.document_id, idx""",
    "seg_walk",
    "seg_pages",
)
oracle(
    "attest_segments",
    f"""SELECT document_id, segment_id, segment_index, page_numbers[1] AS page_start, page_numbers[-1] AS page_end, chunk_start_index, chunk_end_index, sha256(text) AS text_hash,
  left(list_filter(ls, lambda x: length(x) >= 4 AND lower(x) NOT IN ('tinglysningsattest', 'servitutter'))[1], 160) AS heading, left(sc[1], 240) AS raw_scope_text,
  array_to_string(page_numbers, ',') AS page_numbers, {first10(DATE_REF)} AS dates,
  {first10(r'\b(?:\d+\s*[A-ZÆØÅ]\s*-?\s*\d+|[A-ZÆØÅ]-\d+|\d+\s*[A-ZÆØÅ]\s*\d+)\b')} AS archives,
  array_to_string(list_filter(pr, lambda x, i: list_position(pr, x) = i), '|') AS parcels
 FROM (SELECT *, list_transform(regexp_extract_all(array_to_string(sc, ' '), '{PARCEL}'), lambda x: lower(x)) AS pr FROM (
   SELECT *, list_transform(string_split(text, chr(10)), lambda x: {strip('x')}) AS ls, {SCOPE} AS sc FROM segments))""",
    "segments",
)
oracle(
    "segment_chunks",
    "SELECT segment_id, chunk_id, page, chunk_index FROM (SELECT *, unnest(page_numbers) AS page FROM segments) s JOIN chunks c USING (case_id, document_id, page)",
    "segments",
    "chunks",
)
cte(
    "signatures",
    """
 SELECT case_id, document_id, sha256(string_agg(h, chr(10) ORDER BY bb)) AS source_signature FROM (
  SELECT case_id, document_id, b // 512 AS bb, sha256(string_agg(h, chr(10) ORDER BY b)) AS h FROM (
   SELECT case_id, document_id, chunk_index // 512 AS b, sha256(string_agg(sha256(page::varchar || ':' || chunk_index::varchar || ':' || text), chr(10) ORDER BY page, chunk_index)) AS h
   FROM chunks GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "chunks",
)
oracle("source_signature", "SELECT * FROM signatures", "signatures")
NUM = "regexp_extract(document_id, '(\\d+)', 1)::int"
oracle(
    "reusable_state",
    f"SELECT case_id, document_id, {NUM} % 7 <> 0 AND {NUM} % 5 <> 0 AND {NUM} % 4 NOT IN (0, 3) AS reused FROM signatures",
    "signatures",
)
cte(
    "seg_state",
    f"""SELECT case_id, document_id, page_number AS segment_index, CASE WHEN n % 13 = 0 THEN 'failed' WHEN n % 4 = 0 THEN 'pending' ELSE 'completed' END AS status,
  n % 3 AS records, CASE WHEN n % 5 = 0 THEN 8000 WHEN n % 6 = 0 THEN NULL ELSE 16000 END AS budget FROM (SELECT *, {NUM} + page_number AS n FROM raw_pages)""",
    "raw_pages",
)
oracle(
    "segment_rework",
    """SELECT document_id, segment_index, CASE WHEN status <> 'completed' THEN 'pending' WHEN budget < 16000 THEN 'token-budget hævet' ELSE '0 servitutter tidligere' END AS reason
  FROM seg_state WHERE status <> 'completed' OR records = 0 OR coalesce(budget < 16000, false)""",
    "seg_state",
)
oracle(
    "completeness_gate",
    "SELECT case_id, document_id, count(*) FILTER (status = 'failed') AS failed_segments, count(*) AS total_segments FROM seg_state GROUP BY 1, 2",
    "seg_state",
)
oracle(
    "rejected_cases",
    """SELECT case_id, count(*) AS incomplete_documents, sum(f) AS failed_segments FROM (SELECT case_id, document_id, count(*) FILTER (status = 'failed') AS f FROM seg_state GROUP BY 1, 2)
  WHERE f > 0 GROUP BY 1""",
    "seg_state",
)
cte(
    "artifact_files",
    """SELECT case_id, doc_id, max(t) FILTER (i = 0) AS pdf, max(t) FILTER (i = 1) AS ocr, max(t) FILTER (i = 2) AS pages, max(t) FILTER (i = 3) AS chunks
 FROM (SELECT case_id, doc_id, i, modified_at + to_minutes(((doc_id * (i + 1)) % 7)::int) AS t FROM file_manifest CROSS JOIN range(4) r(i) WHERE doc_id % 8 <> i + 4) GROUP BY 1, 2""",
    "file_manifest",
)
oracle(
    "artifact_stale",
    """SELECT case_id, 'doc-' || doc_id::varchar AS document_id, unnest(['ocr', 'pages', 'chunks']) AS artifact,
  unnest([NOT coalesce(ocr >= pdf, false), NOT coalesce(pages >= pdf AND pages >= ocr, false), NOT coalesce(chunks >= pages, false)]) AS stale FROM artifact_files""",
    "artifact_files",
)

# ---- answers --------------------------------------------------------------------------------------------------
# which wrapping the generator used decides what a reader must find
cte(
    "answer_items",
    """
 SELECT a.*, d.doc_id, d.source, unnest(range(CASE doc_id % 8 WHEN 0 THEN 2 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 3 ELSE 1 END)) AS pos
 FROM answers a JOIN documents d ON a.document_id = 'doc-' || d.doc_id::varchar""",
    "answers",
)
FENCE = r"(?is)```(?:json)?\s*(.*?)```"
oracle(
    "json_salvage",
    f"""SELECT document_id, len(list_distinct(list_filter([t] || list_transform(regexp_extract_all(t, '{FENCE}', 1), lambda x: {strip('x')}) || [regexp_extract(t, '(?s)\\[.*\\]'), regexp_extract(t, '(?s)\\{{.*\\}}')],
     lambda x: x <> ''))) AS candidates,
  CASE doc_id % 8 WHEN 0 THEN 2 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 3 ELSE 1 END AS items
 FROM (SELECT document_id, {strip('response_text')} AS t FROM answers) a JOIN documents d ON a.document_id = 'doc-' || d.doc_id::varchar""",
    "answers",
)
oracle(
    "json_records",
    """SELECT document_id, pos::int AS priority, 'srv-' || sha256(case_id || '|' || document_id || '|' || pos::varchar) AS servitut_id,
  (doc_id % 9 + 1)::varchar || '.2.19' || (50 + doc_id % 40)::varchar AS date_reference,
  CASE WHEN doc_id % 3 = 0 THEN DATE '1968-05-01' ELSE make_date(1950 + doc_id % 40, 2, doc_id % 9 + 1) END AS registered_at,
  CASE WHEN doc_id % 4 <> 1 THEN '40 F ' || (doc_id % 13)::varchar END AS akt_nr,
  replace(source, 'src', CASE WHEN doc_id % 8 = 0 AND pos = 1 THEN 'Anden ' ELSE 'Titel ' END) AS title,
  CASE WHEN case_id LIKE '%0' THEN 'attest' ELSE 'akt' END AS scope_source,
  CASE doc_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.25 END AS confidence,
  CASE doc_id % 3 WHEN 0 THEN '1a|2b' WHEN 1 THEN '7c' ELSE '' END AS applies, CASE doc_id % 3 WHEN 0 THEN '1a|2b' WHEN 1 THEN '7c' ELSE '' END AS raw FROM answer_items""",
    "answer_items",
)
oracle(
    "report_answers",
    f"""SELECT i.case_id, CASE WHEN n % 3 = 0 THEN 'ukendt' ELSE i.servitut_id END AS servitut_id, i.date_reference,
   CASE WHEN n % 2 = 1 THEN 'Tekst' WHEN n % 3 = 0 AND i.date_reference IS NULL THEN ' - ' WHEN i.title IS NULL OR i.title = '' THEN ' - ' ELSE {lit(fixed.TEXT_NO_DEED_PREFIX)} || i.title END AS description,
   {lit(fixed.TEXT_LOOK_UP)} AS action, CASE WHEN n % 5 = 0 THEN 'Ja' ELSE 'Nej' END AS scope, n % 7 = 0 OR n % 5 = 0 AS relevant_for_project,
   CASE WHEN n % 3 = 0 AND i.date_reference IS NULL THEN NULL ELSE e.raw_text END AS raw_text
 FROM (SELECT *, split_part(servitut_id, '-', 2)::int AS n FROM report_inputs) i JOIN report_entries e ON e.case_id = i.case_id AND e.servitut_id = i.servitut_id""",
    "report_inputs",
    "report_entries",
)
oracle(
    "chat_content",
    f"""SELECT conv_id, turn, content, CASE WHEN content IS NULL THEN 'empty response' END AS error FROM (
  SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN nullif({strip('text')}, '') ELSE {strip("CASE WHEN text = '' THEN 'slut ' ELSE text || chr(10) || 'slut ' END")} END AS content FROM conversations)""",
)
oracle(
    "answer_join",
    """SELECT document_id, CASE WHEN length(response_text) % 3 > 0 THEN response_text END AS response_text,
  CASE WHEN length(response_text) % 3 > 0 THEN NULL ELSE 'no response' END AS error FROM answers""",
    "answers",
)
cte(
    "parcels",
    rf"""
 SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY case_id, parcel_key ORDER BY pos, i) AS rn FROM (
  SELECT case_id, pos, i, lower(num) AS matrikelnummer, {pkey('num')} AS parcel_key, trim(regexp_replace(district, '[{BLANK}]+', ' ', 'g')) AS landsejerlav, area::bigint AS areal_m2 FROM (
   SELECT case_id, pos, unnest(regexp_extract_all(t, '{{P}}', 1)) AS district, unnest(regexp_extract_all(t, '{{P}}', 2)) AS num, unnest(regexp_extract_all(t, '{{P}}', 3)) AS area,
     generate_subscripts(regexp_extract_all(t, '{{P}}', 1), 1) - 1 AS i
   FROM (SELECT d.case_id, d.pos, string_agg(text, chr(10) ORDER BY page_number) AS t FROM documents_meta d JOIN (SELECT *, row_number() OVER (PARTITION BY case_id, document_id ORDER BY page_number) AS r FROM clean_pages) p
     ON p.case_id = d.case_id AND p.document_id = d.document_id AND r <= 2 WHERE document_type = 'tinglysningsattest' GROUP BY 1, 2)))) WHERE rn = 1""".replace(
        "{P}", r"(?is)Landsejerlav:\s*(.+?)\s*Matrikelnummer:\s*([0-9A-Za-z]+)\s*Areal:\s*([0-9]+)\s*m2"
    ),
    "documents_meta",
    "clean_pages",
)
cte(
    "prompts",
    f"""
 SELECT c.case_id, c.document_id, 'Register:' || chr(10) || j || chr(10) || 'Parceller: [' || coalesce(pj, '') || ']' || chr(10) || 'Kilde: ' || m.filename || chr(10) || chr(10) || ct || chr(10) AS prompt
 FROM (SELECT case_id, document_id, string_agg('[Dok: ' || document_id || ' | Side ' || page::varchar || ' | Chunk ' || chunk_index::varchar || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS ct
       FROM chunks JOIN (SELECT case_id, document_id, chunk_index FROM selection WHERE selected) USING (case_id, document_id, chunk_index) GROUP BY 1, 2) c
 JOIN documents_meta m USING (case_id, document_id)
 JOIN (SELECT case_id, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "date_reference": ' || coalesce(to_json(date_reference)::varchar, 'null') || ',' || chr(10) || '    "akt_nr": ' || coalesce(to_json(akt_nr)::varchar, 'null') ||
         ',' || chr(10) || '    "title": ' || coalesce(to_json(title)::varchar, 'null') || chr(10) || '  }}', ',' || chr(10) ORDER BY ord) || chr(10) || ']' AS j FROM canonicals GROUP BY 1) k ON k.case_id = c.case_id
 LEFT JOIN (SELECT case_id, string_agg('"' || matrikelnummer || '"', ', ' ORDER BY pos, i) AS pj FROM parcels GROUP BY 1) p ON p.case_id = c.case_id""",
    "chunks",
    "selection",
    "documents_meta",
    "canonicals",
    "parcels",
)
oracle(
    "prompt_text",
    "SELECT case_id, document_id, sha256(prompt) AS prompt_hash, length(prompt) AS chars, 4096 AS max_tokens, NULL::varchar AS error FROM prompts",
    "prompts",
)
oracle(
    "report_input_json",
    f"SELECT servitut_id, {SORT_DATE} AS sort_date, title, registered_at::varchar AS registered_at, applies::varchar AS applies FROM report_inputs",
    "report_inputs",
)
oracle(
    "prompt_settings",
    """SELECT document_id, CASE WHEN document_type = 'akt' THEN 4096 ELSE 16000 END AS max_tokens, CASE WHEN document_type = 'akt' THEN 'akt' ELSE 'attest' END AS scope_source,
  coalesce(trim(requested_type), 'standard') AS model, document_type AS kept_type FROM documents_meta""",
    "documents_meta",
)

# ---- evidence -------------------------------------------------------------------------------------------------
cte("first_ev", "SELECT case_id, document_id, chunk_index AS pos, chunk_id, page, left(text, 300) AS text_excerpt FROM chunks WHERE chunk_index < 3", "chunks")
oracle("first_evidence", "SELECT document_id, pos, chunk_id, page, text_excerpt FROM first_ev", "first_ev")
oracle(
    "evidence_pick",
    f"""SELECT item_ord, chunk_index, chunk_id, page, anyhit AS named FROM (SELECT *, row_number() OVER (PARTITION BY case_id, item_ord ORDER BY chunk_index) AS rn FROM (
   SELECT *, bool_or(hit) OVER (PARTITION BY case_id, item_ord) AS anyhit FROM (
    SELECT i.case_id, i.ord AS item_ord, c.chunk_index, c.chunk_id, c.page,
      coalesce(contains({akey('c.text')}, nullif({akey('i.date_reference')}, '')), false) OR coalesce(contains({akey('c.text')}, i.ak), false) AS hit
    FROM items_c i JOIN chunks c ON c.case_id = i.case_id AND c.document_id = i.document_id
    JOIN selection s ON s.case_id = c.case_id AND s.document_id = c.document_id AND s.chunk_index = c.chunk_index AND s.selected)) WHERE hit OR NOT anyhit) WHERE rn <= 3""",
    "items_c",
    "chunks",
    "selection",
)
oracle(
    "rag_top_k",
    r"""SELECT case_id, servitut_id, document_id, chunk_index, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY servitut_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM (
   SELECT r.case_id, r.servitut_id, c.document_id, c.chunk_index, len(list_filter(r.words, lambda x: contains(lower(c.text), x))) / len(r.words) AS score
   FROM (SELECT *, list_distinct(regexp_extract_all(lower(concat_ws(' ', nullif(title, ''), summary, beneficiary)), '[\p{L}\p{N}_]{3,}')) AS words,
           CASE WHEN ord % 8 = 0 THEN 'doc-x' ELSE source_document END AS src FROM canonicals) r
   JOIN chunks c ON c.case_id = r.case_id AND (c.document_id = r.src OR NOT EXISTS (SELECT 1 FROM chunks e WHERE e.case_id = r.case_id AND e.document_id = r.src))
   WHERE len(r.words) > 0) WHERE score > 0) WHERE rank <= 5""",
    "canonicals",
    "chunks",
)
cte("chunk_sizes", "SELECT document_id, chunk_id, length(text) AS chunk_chars FROM chunks", "chunks")
cte("page_sizes", "SELECT document_id, page_number AS page, least(length(text), 1500) AS page_chars, confidence AS page_confidence FROM quality_pages", "quality_pages")
cte("record_keys", "SELECT servitut_id, source_document AS document_id FROM canonicals", "canonicals")
cte("lineage", "SELECT servitut_id, document_id, pos, chunk_id, page FROM record_keys JOIN first_ev USING (document_id)", "record_keys", "first_ev")
oracle(
    "evidence_lineage",
    """SELECT servitut_id, pos, chunk_id, page, chunk_chars, page_chars, page_confidence FROM lineage LEFT JOIN chunk_sizes USING (document_id, chunk_id)
  LEFT JOIN page_sizes USING (document_id, page)""",
    "lineage",
    "chunk_sizes",
    "page_sizes",
)

# ---- parcels --------------------------------------------------------------------------------------------------
oracle(
    "parcel_normalize",
    f"SELECT servitut_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS parcels FROM (SELECT servitut_id, {pkeys('applies_to_matrikler')} AS a FROM records)",
    "records",
)
oracle("parcel_parse", "SELECT case_id, parcel_key, matrikelnummer, landsejerlav, areal_m2 FROM parcels", "parcels")
oracle("target_scope", "SELECT servitut_id, applies AS applies_to_target_matrikel FROM scoped", "scoped")
oracle("matching_targets", "SELECT servitut_id, array_to_string(matching, ' og ') AS targets FROM scoped", "scoped")
cte(
    "target_cases",
    "SELECT DISTINCT case_id, CASE WHEN case_id LIKE '%n-0' THEN '00003 A' WHEN case_id LIKE '%0' THEN '9x' END AS target_matrikel FROM documents_meta",
    "documents_meta",
)
oracle(
    "target_sync",
    f"""SELECT c.case_id, coalesce(p.matrikelnummer, f.m, c.target_matrikel) AS target_matrikel FROM target_cases c
  LEFT JOIN parcels p ON p.case_id = c.case_id AND p.parcel_key = {pkey('c.target_matrikel')}
  LEFT JOIN (SELECT case_id, arg_min(matrikelnummer, (pos, i)) AS m FROM parcels GROUP BY 1) f ON f.case_id = c.case_id""",
    "target_cases",
    "parcels",
)
oracle(
    "target_update",
    """SELECT c.case_id, CASE WHEN c.case_id LIKE '%r-0' THEN CASE WHEN h.case_id IS NULL THEN '44q' ELSE c.target_matrikel END
   ELSE CASE WHEN p.matrikelnummer IS NOT NULL THEN p.matrikelnummer WHEN h.case_id IS NULL THEN '0005a' ELSE c.target_matrikel END END AS target_matrikel
  FROM target_cases c LEFT JOIN parcels p ON p.case_id = c.case_id AND p.parcel_key = '5a' LEFT JOIN (SELECT DISTINCT case_id FROM parcels) h ON h.case_id = c.case_id""",
    "target_cases",
    "parcels",
)

# ---- ranges, imports, store, stats ------------------------------------------------------------------------------
oracle(
    "page_ranges_suggest",
    """SELECT document_id, (i + 1) AS part, i * 3 + 1 AS start_page, least(i * 3 + 3, page_count) AS end_page,
   (i * 3 + 1)::varchar || '-' || least(i * 3 + 3, page_count)::varchar || ' | Del ' || (i + 1)::varchar AS line
 FROM (SELECT *, unnest(range((page_count + 2) // 3)) AS i FROM documents_meta)""",
    "documents_meta",
)
# every spec has few lines, so the expected outcome is written out per kind
cte(
    "spec_lines",
    """SELECT document_id, page_count + 5 AS total, pos % 5 AS kind, unnest(CASE pos % 5 WHEN 0 THEN [1, 3, 4] WHEN 1 THEN [1, 2, 3] WHEN 2 THEN [1, 2, 3] ELSE [1, 2] END) AS line_number FROM documents_meta""",
    "documents_meta",
)
cte(
    "ranges",
    """
 SELECT document_id, line_number,
  CASE kind WHEN 0 THEN CASE line_number WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 4 END WHEN 1 THEN CASE line_number WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 6 END
    WHEN 2 THEN CASE line_number WHEN 1 THEN NULL WHEN 2 THEN 2 ELSE 0 END WHEN 3 THEN CASE line_number WHEN 1 THEN 2 ELSE 1 END ELSE CASE line_number WHEN 1 THEN NULL ELSE 1 END END AS start_page,
  CASE kind WHEN 0 THEN CASE line_number WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 6 END WHEN 1 THEN CASE line_number WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 6 END
    WHEN 2 THEN CASE line_number WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END WHEN 3 THEN CASE line_number WHEN 1 THEN total + 1 ELSE 1 END ELSE CASE line_number WHEN 1 THEN NULL ELSE 1 END END AS end_page,
  CASE WHEN kind = 0 AND line_number = 1 THEN 'Attest' WHEN kind = 0 AND line_number = 4 THEN 'Akt 2' WHEN kind = 4 AND line_number = 1 THEN 'etiket' WHEN kind = 4 THEN 'A/B: c' END AS label,
  CASE WHEN kind = 1 AND line_number = 2 THEN 'Sideintervaller må ikke overlappe' WHEN kind = 2 AND line_number = 1 THEN 'Linje 1: ugyldigt sideinterval ''x-3'''
    WHEN kind = 2 AND line_number = 2 THEN 'Linje 2: startside må ikke være større end slutside' WHEN kind = 2 THEN 'Linje 3: sidetal skal starte ved 1'
    WHEN kind = 3 AND line_number = 1 THEN 'Linje 1: side ' || (total + 1)::varchar || ' findes ikke i PDF''en (' || total::varchar || ' sider)'
    WHEN kind = 4 AND line_number = 1 THEN 'Linje 1: mangler sideinterval'
    WHEN kind = 0 AND line_number = 4 AND total < 6 THEN 'Linje 4: side 6 findes ikke i PDF''en (' || total::varchar || ' sider)' END AS error
 FROM spec_lines""",
    "spec_lines",
)
oracle("page_ranges_parse", "SELECT * FROM ranges", "ranges")
oracle(
    "page_parts",
    """SELECT p.document_id, p.page_number, r.part, r.document_id || '_' || CASE label WHEN 'Attest' THEN 'Attest' WHEN 'Akt 2' THEN 'Akt_2' WHEN 'A/B: c' THEN 'A-B-_c'
   ELSE 'del-' || lpad(part::varchar, 2, '0') || '_p' || start_page::varchar || '-' || end_page::varchar END || '.pdf' AS part_file
 FROM raw_pages p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_number) AS part FROM ranges WHERE error IS NULL) r
  ON r.document_id = p.document_id AND p.page_number BETWEEN r.start_page AND r.end_page""",
    "raw_pages",
    "ranges",
)
cte(
    "audit",
    """
 SELECT case_id, name, content_hash, CASE WHEN modified_at <= TIMESTAMP '2024-01-01 01:00:00' THEN 'skipped_old' WHEN known THEN 'skipped_existing'
   WHEN row_number() OVER (PARTITION BY case_id, content_hash, modified_at <= TIMESTAMP '2024-01-01 01:00:00' ORDER BY name) > 1 THEN 'skipped_batch' ELSE 'imported' END AS outcome
 FROM (SELECT case_id, name, modified_at, sha256(content) AS content_hash, EXISTS (SELECT 1 FROM file_manifest k WHERE k.case_id = f.case_id AND k.doc_id % 23 = 0 AND k.content = f.content) AS known
   FROM file_manifest f WHERE lower(name) LIKE '%.pdf')""",
    "file_manifest",
)
oracle("import_audit", "SELECT case_id, name, content_hash, outcome FROM audit", "audit")
oracle("import_counts", "SELECT case_id, outcome, count(*) AS files FROM audit GROUP BY 1, 2", "audit")
oracle(
    "clean_names",
    rf"""SELECT page_id, coalesce(nullif({strip("regexp_replace(url, '[<>:" + '"' + r"/\\|?*]', '_', 'g')")}, ''), 'fil') AS download_name,
  coalesce(nullif(trim(regexp_replace(regexp_replace({strip('url')}, '[{BLANK}]+', '_', 'g'), '[^0-9A-Za-z._-]+', '-', 'g'), '._-'), ''), 'del') AS component FROM pages""",
)
oracle(
    "unique_links",
    """SELECT page_id, index, href FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY index) AS rn FROM (
   SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS index FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)) WHERE href <> '') WHERE rn = 1""",
)
cte(
    "stats",
    """
 SELECT c.case_id, documents, ocr_ready, pages, chunks, coalesce(servitutter, 0) AS servitutter, coalesce(reports, 0) AS reports, CASE WHEN c.case_id LIKE '%0' THEN 'done' ELSE 'ukendt' END AS case_status
 FROM (SELECT case_id, count(*) AS documents, count(*) FILTER (parse_status = 'ocr_done') AS ocr_ready, sum(page_count) AS pages, sum(chunk_count) AS chunks, count(*) FILTER (pos % 6 = 0) AS reports FROM documents_meta GROUP BY 1) c
 LEFT JOIN (SELECT case_id, count(*) AS servitutter FROM canonicals GROUP BY 1) r USING (case_id)""",
    "documents_meta",
    "canonicals",
)
oracle(
    "case_stats",
    "SELECT *, CASE WHEN documents = 0 THEN 'upload' WHEN chunks = 0 THEN 'ocr' WHEN servitutter = 0 THEN 'filter' WHEN reports = 0 THEN 'report' ELSE 'edit' END AS next_step FROM stats",
    "stats",
)
oracle("workspace_totals", "SELECT count(*) AS cases, sum(documents) AS documents, sum(servitutter) AS servitutter, sum(reports) AS reports FROM stats", "stats")
oracle(
    "pending_docs",
    """SELECT document_id, CASE parse_status WHEN 'pending' THEN 'Afventer OCR' WHEN 'processing' THEN 'Kører OCR' ELSE 'Fejl' END AS status_label,
  CASE parse_status WHEN 'processing' THEN 'Kører' WHEN 'error' THEN 'Fejl' ELSE 'I kø' END AS batch_state,
  CASE parse_status WHEN 'processing' THEN 'OCRmyPDF og tekstudtræk i gang' WHEN 'error' THEN 'Kræver ny kørsel' ELSE 'Afventer behandling' END AS batch_detail FROM documents_meta WHERE parse_status <> 'ocr_done'""",
    "documents_meta",
)
oracle("next_pending", "SELECT case_id, arg_min(document_id, pos) AS document_id FROM documents_meta WHERE parse_status <> 'ocr_done' GROUP BY 1", "documents_meta")
oracle(
    "reading_estimate",
    "SELECT case_id, s AS seconds, CASE WHEN s < 60 THEN s::varchar || 's' ELSE (s // 60)::varchar || 'm ' || (s % 60)::varchar || 's' END AS label FROM (SELECT case_id, sum(page_count) * 5 AS s FROM documents_meta WHERE parse_status <> 'ocr_done' GROUP BY 1)",
    "documents_meta",
)
oracle(
    "reading_evaluation",
    f"""SELECT case_id, mean_confidence, total_chars, coalesce(chunks, 0) AS chunks, coalesce(keyword_chunks, 0) AS keyword_chunks FROM (SELECT case_id, round(coalesce(avg(confidence) FILTER (confidence >= 0.4), 0), 6) AS mean_confidence, sum(length(text)) AS total_chars FROM quality_pages GROUP BY 1)
  LEFT JOIN (SELECT case_id, count(*) AS chunks, count(*) FILTER ({KW}) AS keyword_chunks FROM chunks GROUP BY 1) USING (case_id)""",
    "quality_pages",
    "chunks",
)
oracle(
    "latest_report",
    "SELECT case_id, 'rep-' || max(pos)::varchar AS report_id, max(pos) AS created_at FROM documents_meta WHERE pos % 6 = 0 GROUP BY 1",
    "documents_meta",
)
oracle(
    "canonical_source",
    """SELECT case_id, 'kanon-' || case_id AS servitut_id, 'stored' AS origin FROM record_cases WHERE pos % 3 = 0
  UNION ALL SELECT case_id, servitut_id, 'saved' FROM records WHERE attest_confirmed AND case_id IN (SELECT case_id FROM record_cases WHERE pos % 3 <> 0)""",
    "record_cases",
    "records",
)
oracle(
    "tracked_documents",
    """SELECT DISTINCT case_id, document_id FROM raw_pages p WHERE NOT EXISTS (SELECT 1 FROM documents_meta m WHERE m.case_id = p.case_id AND m.document_id = p.document_id AND document_type = 'tinglysningsattest'
   AND m.case_id IN (SELECT case_id FROM canonicals WHERE confidence > 0.7))""",
    "raw_pages",
    "documents_meta",
    "canonicals",
)
STATUS_SQL = """CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'browser_started' WHEN 'click' THEN 'downloading_documents'
  WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'completed' ELSE 'importing_documents' END ELSE CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'waiting_for_login' END END"""
oracle(
    "active_job",
    f"""SELECT case_id, max(job_id) AS job_id, arg_max(status, job_id) AS status FROM (SELECT 'case-' || (user_id % 20)::varchar AS case_id, 'job-' || lpad(event_id::varchar, 9, '0') AS job_id, {STATUS_SQL} AS status FROM events)
  WHERE status NOT IN ('completed', 'failed', 'cancelled') GROUP BY 1""",
)
oracle(
    "upsert_records",
    """SELECT case_id, servitut_id, CASE WHEN ord % 5 = 0 THEN title || '!' ELSE title END AS title FROM canonicals UNION ALL SELECT case_id, item_id, title FROM deed_items""",
    "canonicals",
    "deed_items",
)
oracle(
    "cascade_delete",
    """SELECT document_id, 0 AS page_number FROM documents_meta WHERE pos % 3 <> 0 UNION ALL SELECT p.document_id, p.page_number FROM raw_pages p JOIN documents_meta m USING (document_id) WHERE pos % 3 <> 0""",
    "documents_meta",
    "raw_pages",
)
oracle(
    "ordered_chunks",
    """SELECT c.case_id, l.pos, c.document_id, c.chunk_index FROM chunks c JOIN (
   SELECT document_id, CASE WHEN pos % 4 = 1 THEN coalesce(max(pos) FILTER (pos % 4 <> 1) OVER (PARTITION BY case_id), -1) + row_number() OVER (PARTITION BY case_id, pos % 4 = 1 ORDER BY pos) ELSE pos END AS pos FROM documents_meta) l USING (document_id)""",
    "chunks",
    "documents_meta",
)
oracle("case_status_update", "SELECT case_id, CASE WHEN pos % 2 = 1 THEN 'error' ELSE status END AS status FROM record_cases", "record_cases")
oracle(
    "report_document",
    f"""SELECT case_id, report_id, row_number() OVER (PARTITION BY case_id ORDER BY part, i) AS line_no, line FROM (
   SELECT case_id, 'rep-' || case_id AS report_id, 0 AS part, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, ['# Rapport rep-' || case_id, ''] ||
     CASE WHEN len(target_matrikler) > 0 THEN ['**Projektmatrikler:** ' || array_to_string(target_matrikler, ', '), '**Ejendommens matrikler:** ' || coalesce(nullif(array_to_string(available_matrikler, ', '), ''), 'Ikke angivet'),
       '**Ajour pr. dato:** ' || CASE WHEN pos % 2 = 0 THEN '{AS_OF}' ELSE 'Ikke angivet' END, ''] ELSE [] END ||
     CASE WHEN pos % 3 = 0 THEN ['## Bemærkninger', 'Note', ''] ELSE [] END || ['## Tabel'] AS ls FROM record_cases)
   UNION ALL SELECT case_id, 'rep-' || case_id, 1, line_no, line FROM md_table)""",
    "record_cases",
    "md_table",
)

# ---- streams: the final state as a batch ------------------------------------------------------------------------
oracle(
    "stream_job_state",
    f"""SELECT 'job-' || user_id::varchar AS job_id, CASE WHEN e_ts IS NOT NULL THEN e_st WHEN date_diff('second', n_ts, TIMESTAMP '2024-01-31 00:00:00') > 86400 THEN 'failed' ELSE n_st END AS status,
   coalesce(e_ts, n_ts) AS last_heartbeat_at, CASE WHEN e_ts IS NULL AND date_diff('second', n_ts, TIMESTAMP '2024-01-31 00:00:00') > 86400 THEN 'Timeout' END AS error_message
 FROM (SELECT user_id, min(ts) FILTER (st IN ('completed', 'failed')) AS e_ts, arg_min(st, ts) FILTER (st IN ('completed', 'failed')) AS e_st, max(ts) AS n_ts, arg_max(st, ts) AS n_st
   FROM (SELECT *, {STATUS_SQL} AS st FROM events) GROUP BY 1)""",
)
# event by event: a run moves on, ends, or is followed by the next one; times of the last delay are not final yet
oracle(
    "stream_job_runs",
    f"""WITH RECURSIVE e AS MATERIALIZED (
   SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY us, st) AS n
   FROM (SELECT 'job-' || user_id::varchar AS job_id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 100 AS us, {STATUS_SQL} AS st FROM events)),
 final AS MATERIALIZED (SELECT max(us) // 1000 * 1000 - 600000000 AS wm FROM e),
 known AS MATERIALIZED (SELECT e.* FROM e JOIN (SELECT job_id, max(us) AS last FROM e GROUP BY 1) AS newest USING (job_id), final WHERE us <= greatest(wm, last - 600000000)),
 walk AS (
   SELECT job_id, n, us, st, us AS started, CASE WHEN st = 'waiting_for_login' THEN us END AS waiting, 1 AS events FROM known WHERE n = 1
   UNION ALL
   SELECT job_id, n, us, st, CASE WHEN fresh THEN us ELSE started END,
     CASE WHEN st <> 'waiting_for_login' THEN NULL WHEN fresh OR waiting IS NULL THEN us ELSE waiting END, CASE WHEN fresh THEN 1 ELSE events + 1 END
   FROM (SELECT k.job_id, k.n, k.us, k.st, w.started, w.waiting, w.events,
       w.st IN ('completed', 'failed', 'cancelled') OR k.us > least(w.us + 300000000, coalesce(w.waiting + 600000000, w.us + 300000000)) AS fresh
     FROM walk w JOIN known k ON k.job_id = w.job_id AND k.n = w.n + 1)),
 ends AS (
   SELECT *, st IN ('completed', 'failed', 'cancelled') AS done, least(us + 300000000, coalesce(waiting + 600000000, us + 300000000)) AS deadline,
     lead(started) OVER (PARTITION BY job_id ORDER BY n) AS next_start, lead(us) OVER (PARTITION BY job_id ORDER BY n) AS next_us FROM walk)
 SELECT job_id, started AS started_at, CASE WHEN done THEN us ELSE deadline END AS ended_at, CASE WHEN done THEN st ELSE 'failed' END AS status,
   CASE WHEN NOT done THEN 'Timeout' END AS error_message, events::bigint AS events
 FROM ends, final WHERE done OR next_start = next_us AND next_start > started OR next_us IS NULL AND deadline < wm
   AND NOT EXISTS (SELECT 1 FROM e WHERE e.job_id = ends.job_id AND e.n = ends.n + 1 AND e.us <= ends.deadline)""",
)
STAGE_SQL = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'parsing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
oracle(
    "stream_progress",
    f"SELECT 'doc-' || user_id::varchar AS doc_id, max(ts) AS ts, arg_max({STAGE_SQL}, ts) AS stage, arg_max(round(value / 100, 4), ts) AS progress, count(*) AS events FROM events GROUP BY 1",
)
oracle("stream_progress_windows", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {STAGE_SQL} AS stage, count(*) AS events FROM events GROUP BY 1, 2")
oracle(
    "stream_closing_windows",
    f"""WITH e AS (SELECT ts, {STAGE_SQL} AS stage, least((day(ts) - 1) // 8 + CASE WHEN event_id % 11 = 3 THEN 1 ELSE 0 END, 3) AS week FROM events),
 marks AS (SELECT w.week, (SELECT max(ts) FROM e WHERE e.week < w.week) - INTERVAL 1 DAY AS mark FROM (SELECT unnest(range(0, 5)) AS week) w),
 marked AS (SELECT date_trunc('day', ts) AS d, stage, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM e JOIN marks USING (week))
 SELECT strftime(d, '%Y-%m-%d') AS day, stage, count(*) FILTER (NOT late) AS events, count(*) FILTER (late) AS late,
   d + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE week = 4) AS closed FROM marked GROUP BY d, stage""",
)
oracle(
    "progress_share",
    f"""SELECT 'case-' || (user_id % 20)::varchar AS case_id, count(DISTINCT user_id) AS documents, count(DISTINCT user_id) FILTER ({STAGE_SQL} IN ('completed', 'failed')) AS finished FROM events GROUP BY 1""",
)
oracle("stream_import", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")

# ---- composed extraction --------------------------------------------------------------------------------------
oracle(
    "sql_functions",
    f"""SELECT servitut_id, {akey('akt_nr')} AS akt_key, {mkey('date_reference')} AS date_key, nullif(regexp_replace(lower(title), '[^0-9a-z]+', '', 'g'), '') AS title_key,
  {SORT_DATE} AS sort_date, coalesce(beneficiary = 'Vejle Amt', false) AS amt, {pkey('applies_to_matrikler[1]')} AS parcel, {lob('date_reference')} AS serial,
  substr(sha256(source_document || ':1:2'), 1, 12) AS chunk_id, coalesce({KW.replace('text', 'title')}, false) AS keyword,
  round(least(1.0, greatest(0.0, (length(regexp_replace(title, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) / length(title) - 0.10) / 0.40)), 3)::double AS quality,
  CASE WHEN attest_confirmed THEN 'Ja' ELSE 'Nej' END AS scope, akt_nr AS clean FROM records""",
    "records",
)
ORACLES["sql_page_functions"] = f"""SELECT document_id, page_number, heading, scope_line, parcels, snippet, serials, starts_entry
  FROM ({ORACLES['parcel_refs']}) JOIN ({ORACLES['keyword_in_context']}) USING (document_id, page_number) JOIN ({ORACLES['archive_numbers']}) USING (document_id, page_number)"""
ORACLES["sql_paragraphs"] = ORACLES["page_paragraphs"]
oracle(
    "sql_page_ranges",
    """SELECT document_id, i + 1 AS part, i * 3 + 1 AS start_page, least(i * 3 + 3, page_count) AS end_page
 FROM (SELECT *, unnest(range((page_count + 2) // 3)) AS i FROM documents_meta)""",
    "documents_meta",
)
oracle(
    "sql_answer_items",
    """SELECT document_id, pos::int AS pos, replace(source, 'src', CASE WHEN doc_id % 8 = 0 AND pos = 1 THEN 'Anden ' ELSE 'Titel ' END) AS title,
   CASE doc_id % 3 WHEN 0 THEN '1a|2b' WHEN 1 THEN '7c' ELSE '' END AS applies
 FROM (SELECT 'doc-' || doc_id::varchar AS document_id, source, doc_id, unnest(range(CASE doc_id % 8 WHEN 0 THEN 2 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 3 ELSE 1 END)) AS pos FROM documents)""",
)
oracle(
    "chunk_types",
    """SELECT p.case_id, coalesce(m.document_type, 'akt') AS document_type, count(*) AS pages FROM (SELECT case_id, document_id FROM raw_pages
   UNION ALL SELECT case_id, 'ukendt-' || document_id FROM raw_pages) p LEFT JOIN documents_meta m USING (case_id, document_id) GROUP BY 1, 2""",
    "raw_pages",
    "documents_meta",
)
oracle("register_pages", "SELECT document_id, page_number FROM raw_pages JOIN documents_meta USING (case_id, document_id) WHERE document_type = 'tinglysningsattest'", "raw_pages", "documents_meta")
oracle(
    "ingest_documents",
    """SELECT case_id, 'doc-' || sha256(case_id || '|' || content_hash) AS document_id, name AS filename, 'akt' AS document_type, 'pending' AS parse_status FROM audit WHERE outcome = 'imported'""",
    "audit",
)

# ---- merging of register records ------------------------------------------------------------------------------
def kkey(x: str) -> str:
    return f"nullif(regexp_replace(lower({x}), '[^0-9a-z]+', '', 'g'), '')"


cte(
    "merge_items",
    f"""
 SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS n, 'doc-' || (ord // 80)::varchar AS doc, {dmy('date_reference')} AS registered_at,
   {kkey('date_reference')} AS dk, {kkey('akt_nr')} AS ak, {kkey('title')} AS tk, length({strip("coalesce(title, '')")}) AS tlen,
   [(ord % 7 + 1)::int, (ord % 9 + 2)::int] AS pages
 FROM (SELECT case_id, ord * 2 AS ord, date_reference, akt_nr, title, applies_to_matrikler AS applies, raw_scope_text AS scope_text, confidence FROM canonicals
       UNION ALL
       SELECT case_id, ord * 2 + 1, date_reference, akt_nr, title, applies_to_matrikler, summary, confidence FROM deed_items)""",
    "canonicals",
    "deed_items",
)
# one step per list position: the clusters so far are a list of structs
cte(
    "folded",
    """folded AS (
 SELECT case_id, n, ord AS home, [{'f': ord, 'd': dk, 'a': ak, 't': tk, 'tl': tlen, 'doc': doc, 'pages': pages}] AS cl FROM merge_items WHERE n = 1
 UNION ALL
 SELECT case_id, n, CASE WHEN pos IS NULL THEN ord ELSE cl[pos].f END,
   CASE WHEN pos IS NULL THEN list_append(cl, {'f': ord, 'd': dk, 'a': ak, 't': tk, 'tl': tlen, 'doc': doc, 'pages': pages})
   ELSE list_concat(list_append(cl[1:pos - 1], {'f': cl[pos].f, 'd': cl[pos].d, 'a': coalesce(cl[pos].a, ak), 't': CASE WHEN tlen > cl[pos].tl THEN tk ELSE cl[pos].t END,
     'tl': greatest(tlen, cl[pos].tl), 'doc': cl[pos].doc, 'pages': list_distinct(list_concat(cl[pos].pages, pages))}), cl[pos + 1:]) END
 FROM (SELECT i.*, cl, coalesce(nullif(list_position([c.d = i.dk FOR c IN cl], true), 0), nullif(list_position([c.a = i.ak FOR c IN cl], true), 0),
         nullif(list_position([c.t = i.tk AND c.doc = i.doc AND (list_has_any(c.pages, i.pages) OR abs(list_min(c.pages) - list_min(i.pages)) <= 1) FOR c IN cl], true), 0)) AS pos
       FROM folded p JOIN merge_items i ON i.case_id = p.case_id AND i.n = p.n + 1))""",
    "merge_items",
)
cte("merge_homes", " SELECT i.*, home FROM merge_items i JOIN folded f USING (case_id, n)", "merge_items", "folded")
oracle(
    "merge_attest",
    f"""SELECT case_id, founder, members, confidence, date_reference, source_document, 'attest' AS scope_source, registered_at, akt_nr, title, raw_scope_text,
  CASE WHEN members = 1 THEN raw ELSE coalesce(once, '') END AS applies_to_matrikler, first_page,
  row_number() OVER (PARTITION BY case_id ORDER BY first_page, coalesce(registered_at::varchar, ''), coalesce(date_reference, ''), coalesce(title, ''), founder) - 1 AS priority
 FROM (SELECT case_id, home AS founder, count(*) AS members, max(confidence) AS confidence, arg_min({{'v': date_reference}}, ord).v AS date_reference,
         arg_min(doc, ord) AS source_document, arg_min(registered_at, ord) FILTER (registered_at IS NOT NULL) AS registered_at,
         arg_min(akt_nr, ord) FILTER (coalesce(akt_nr, '') <> '') AS akt_nr,
         arg_max({{'v': CASE WHEN ord = home THEN title ELSE {strip('title')} END}}, (tlen, -ord)).v AS title,
         arg_max({{'v': CASE WHEN ord = home THEN scope_text ELSE {strip('scope_text')} END}}, (length({strip("coalesce(scope_text, '')")}), -ord)).v AS raw_scope_text,
         arg_min(array_to_string(applies, ','), ord) AS raw, min(list_min(pages)) AS first_page
       FROM merge_homes GROUP BY ALL)
 LEFT JOIN (SELECT case_id, home AS founder, string_agg(v, ',' ORDER BY o, p) AS once FROM (
         SELECT case_id, home, v, min(ord) AS o, arg_min(p, (ord, p)) AS p FROM (SELECT case_id, home, ord, unnest(applies) AS v, generate_subscripts(applies, 1) AS p FROM merge_homes)
         WHERE v <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (case_id, founder)""",
    "merge_homes",
)
oracle(
    "merged_evidence",
    """SELECT case_id, home AS founder, doc AS document_id, page, title AS text_excerpt, 'c' AS chunk_id, min(ord) AS ord
 FROM (SELECT case_id, home, doc, title, ord, unnest(pages) AS page FROM merge_homes) GROUP BY ALL""",
    "merge_homes",
)
oracle(
    "report_prompt",
    f"""SELECT c.case_id, coalesce(n, 0) AS records, 8192 AS max_tokens, {lit(AS_OF)} AS day, '[' || coalesce(array_to_string(['"' || x || '"' FOR x IN target_matrikler], ', '), '') || ']' AS targets
 FROM record_cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM report_inputs GROUP BY 1) USING (case_id)""",
    "record_cases",
    "report_inputs",
)
oracle(
    "chat_blocks",
    f"""SELECT conv_id, turn, {strip("CASE WHEN text = '' THEN 'slut ' ELSE text || chr(10) || 'slut ' END")} AS content FROM conversations""",
)
oracle(
    "report_final",
    f"""SELECT case_id, servitut_id, row_number() OVER (PARTITION BY case_id ORDER BY {SORT_DATE}, servitut_id) AS nr, description, scope, raw_text FROM (
  SELECT e.case_id, e.servitut_id, i.date_reference, e.raw_text,
    CASE WHEN k % 2 = 1 THEN e.description WHEN n % 2 = 1 THEN 'Tekst' WHEN i.title IS NULL OR i.title = '' THEN ' - ' ELSE {lit(fixed.TEXT_NO_DEED_PREFIX)} || i.title END AS description,
    CASE WHEN k % 2 = 1 THEN e.scope WHEN n % 5 = 0 THEN 'Ja' ELSE 'Nej' END AS scope
  FROM (SELECT *, split_part(servitut_id, '-', 2)::int AS n, right(case_id, 1)::int AS k FROM report_inputs) i
  JOIN report_entries e ON e.case_id = i.case_id AND e.servitut_id = i.servitut_id)""",
    "report_inputs",
    "report_entries",
)
oracle(
    "report_notes",
    "SELECT DISTINCT case_id, 'n' AS notes FROM report_inputs WHERE right(case_id, 1)::int % 2 = 0",
    "report_inputs",
)
oracle("browse_chunks", f"SELECT case_id, document_id, chunk_index FROM chunks WHERE page = 2 AND ({KW})", "chunks")
oracle("scoring_compatible", "SELECT case_id, NOT bool_or(pos % 50 = 7) AS compatible FROM documents_meta GROUP BY 1", "documents_meta")

# ---- second pass: the linkage chain once more, over the items of the answers --------------------------------------
DOC_NR = "regexp_extract(document_id, '([0-9]+)', 1)::bigint"
cte("free_chunks", f"SELECT * REPLACE ('fri-' || case_id AS case_id) FROM chunks WHERE {DOC_NR} % 5 = 1 AND {DOC_NR} % 10 <> 0 AND ({KW})", "chunks")
cte(
    "asked",
    f"""SELECT DISTINCT case_id, document_id FROM selection WHERE selected AND {DOC_NR} % 10 <> 0 UNION SELECT DISTINCT case_id, document_id FROM free_chunks""",
    "selection",
    "free_chunks",
)
cte(
    "items_2",
    f"""
 SELECT *, nullif({akey('akt_nr')}, '') AS ak, {COMP} FROM (
  SELECT q.case_id, row_number() OVER (PARTITION BY q.case_id ORDER BY doc_id, pos) AS ord, q.document_id,
    'srv-' || sha256(q.case_id || '|' || q.document_id || '|0|' || pos::varchar) AS servitut_id,
    (doc_id % 9 + 1)::varchar || '.2.19' || (50 + doc_id % 40)::varchar AS date_reference,
    CASE WHEN doc_id % 3 = 0 THEN DATE '1968-05-01' ELSE make_date(1950 + doc_id % 40, 2, doc_id % 9 + 1) END AS registered_at,
    CASE WHEN doc_id % 4 <> 1 THEN '40 F ' || (doc_id % 13)::varchar END AS akt_nr,
    replace(source, 'src', CASE WHEN doc_id % 8 = 0 AND pos = 1 THEN 'Anden ' ELSE 'Titel ' END) AS title,
    CASE doc_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0.25 END AS confidence,
    CASE doc_id % 3 WHEN 0 THEN ['1a', '2b'] WHEN 1 THEN ['7c'] ELSE []::varchar[] END AS applies
  FROM answer_items a JOIN asked q ON q.document_id = a.document_id)""",
    "answer_items",
    "asked",
)
for _name, _from in (("pairs", "items_c"), ("resolved", "items_c"), ("best", "resolved"), ("orphan_rows", "resolved")):
    _body, _needs = CTES[_name]
    _two = {"items_c": "items_2", "pairs": "pairs_2", "resolved": "resolved_2"}
    for _old, _new in _two.items():
        _body = re.sub(rf"\b{_old}\b", _new, _body)
    cte(f"{_name}_2", _body, *[_two.get(n, n) for n in _needs])
# stars of the free cases: each step places the next record and keeps the centres so far
STAR_STEP = """list_filter(w.cs, lambda c: CASE WHEN c.l IS NOT NULL AND i.l IS NOT NULL THEN c.l = i.l
   WHEN c.f IS NOT NULL AND i.f IS NOT NULL THEN c.f = i.f ELSE false END)[1].o"""


def stars(name: str, items: str) -> None:
    """Walk over `items` (case_id, n from 1, ord, l, f) in list order; cs are the centres."""
    cte(
        name,
        f"""{name} AS (
  SELECT case_id, n, ord, ord AS centre, [{{'o': ord, 'l': l, 'f': f}}] AS cs FROM {items} WHERE n = 1
  UNION ALL SELECT case_id, n, ord, coalesce(hit, ord), CASE WHEN hit IS NULL AND (l IS NOT NULL OR f IS NOT NULL) THEN list_append(cs, {{'o': ord, 'l': l, 'f': f}}) ELSE cs END
  FROM (SELECT i.case_id, i.n, i.ord, i.l, i.f, w.cs, {STAR_STEP} AS hit FROM {name} w JOIN {items} i ON i.case_id = w.case_id AND i.n = w.n + 1))""",
        items,
    )


cte("free_items", "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS n FROM items_2 WHERE case_id LIKE 'fri-%'", "items_2")
stars("free_stars", "free_items")
cte(
    "free_records",
    """SELECT i.* FROM free_items i JOIN free_stars s USING (case_id, ord) QUALIFY row_number() OVER (PARTITION BY i.case_id, centre ORDER BY confidence DESC, i.ord) = 1""",
    "free_items",
    "free_stars",
)
OWN_SCOPE = "(len(c.applies_to_matrikler) > 0 OR coalesce(c.raw_scope_text, '') <> '')"
cte(
    "linked_2",
    """SELECT c.*, i.ord AS i_ord, i.document_id AS i_doc, i.akt_nr AS i_akt, i.date_reference AS i_date, i.registered_at AS i_reg, i.confidence AS i_conf, i.applies AS i_applies
  FROM (SELECT *, min(ord) OVER (PARTITION BY case_id, ck) AS first FROM canon_c) c LEFT JOIN best_2 b ON b.case_id = c.case_id AND b.matched_ord = c.first
  LEFT JOIN items_2 i ON i.case_id = c.case_id AND i.ord = b.item_ord""",
    "canon_c",
    "best_2",
    "items_2",
)
cte("orphans_2", "SELECT *, 'srv-' || sha256(case_id || '|' || document_id || '|' || orphan_key) AS orphan_id FROM orphan_rows_2 WHERE case_id NOT LIKE 'fri-%'", "orphan_rows_2")
NEW = "NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, 'akt', confidence"
oracle(
    "extract_records",
    f"""SELECT case_id, ord, servitut_id, coalesce(i_doc, source_document) AS source_document, date_reference, i_reg AS registered_at, coalesce(i_akt, akt_nr) AS akt_nr, title,
   summary, beneficiary, NULL AS disposition_type, NULL AS legal_type, NULL AS action_note, NULL AS byggeri_markering, false AS construction_relevance, raw_scope_text,
   CASE WHEN i_ord IS NULL THEN CASE WHEN ord % 3 > 0 THEN 'attest' END WHEN NOT {OWN_SCOPE} THEN 'akt' ELSE 'attest' END AS scope_source,
   greatest(confidence, i_conf) AS confidence, true AS attest_confirmed,
   array_to_string(CASE WHEN i_ord IS NOT NULL AND NOT {OWN_SCOPE} AND len(i_applies) > 0 THEN i_applies ELSE applies_to_matrikler END, '|') AS applies FROM linked_2 c
  UNION ALL SELECT case_id, ord, orphan_id, document_id, date_reference, registered_at, akt_nr, title, {NEW}, false, array_to_string(applies, '|') FROM orphans_2
  UNION ALL SELECT case_id, ord, servitut_id, document_id, date_reference, registered_at, akt_nr, title, {NEW}, true, array_to_string(applies, '|') FROM free_records""",
    "linked_2",
    "orphans_2",
    "free_records",
)
cte(
    "sought",
    """SELECT case_id, servitut_id, i_doc AS document_id, coalesce(i_date, date_reference) AS date_reference, coalesce(i_akt, akt_nr) AS akt_nr FROM linked_2 WHERE i_ord IS NOT NULL
  UNION ALL SELECT case_id, orphan_id, document_id, date_reference, akt_nr FROM orphans_2""",
    "linked_2",
    "orphans_2",
)
cte(
    "sought_hits",
    f"""SELECT s.case_id, s.servitut_id, c.chunk_index, c.chunk_id, c.document_id, c.page, left(c.text, 300) AS text_excerpt,
    coalesce(contains({akey('c.text')}, nullif({akey('s.date_reference')}, '')), false) OR coalesce(contains({akey('c.text')}, nullif({akey('s.akt_nr')}, '')), false) AS hit
  FROM sought s JOIN chunks c ON c.case_id = s.case_id AND c.document_id = s.document_id
  JOIN selection e ON e.case_id = c.case_id AND e.document_id = c.document_id AND e.chunk_index = c.chunk_index AND e.selected""",
    "sought",
    "chunks",
    "selection",
)
cte(
    "deed_evidence",
    """SELECT case_id, servitut_id, chunk_index, chunk_id, document_id, page, text_excerpt FROM (SELECT *, bool_or(hit) OVER (PARTITION BY case_id, servitut_id) AS anyhit FROM sought_hits)
   WHERE hit OR NOT anyhit
  UNION ALL SELECT r.case_id, r.servitut_id, c.chunk_index, c.chunk_id, c.document_id, c.page, left(c.text, 300) FROM free_records r JOIN free_chunks c USING (case_id, document_id)""",
    "sought_hits",
    "free_records",
    "free_chunks",
)
oracle(
    "extract_evidence",
    """SELECT 'register' AS origin, r.case_id, r.servitut_id, e.pos::bigint AS pos, e.chunk_id, e.document_id, e.page, e.text_excerpt
  FROM canonicals r JOIN first_ev e ON e.case_id = r.case_id AND e.document_id = r.source_document
  UNION ALL SELECT 'deed', case_id, servitut_id, row_number() OVER (PARTITION BY case_id, servitut_id ORDER BY chunk_index) - 1 AS pos, chunk_id, document_id, page, text_excerpt
  FROM deed_evidence QUALIFY pos < 3""",
    "canonicals",
    "first_ev",
    "deed_evidence",
)
# all records as stars, in the order of orders and lines
cte(
    "star_items",
    f"""SELECT case_id, servitut_id, date_reference, ord, n, l, f, filled, confidence FROM (
   SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY a, b, c, d) AS ord, row_number() OVER (PARTITION BY case_id ORDER BY a, b, c, d) AS n FROM (
    SELECT case_id, servitut_id, date_reference, confidence, split_part(servitut_id, '-', 2)::bigint AS a, split_part(servitut_id, '-', 3)::bigint AS b,
      split_part(servitut_id, '-', 4)::bigint AS c, split_part(servitut_id, '-', 5)::bigint AS d, {lob('date_reference')} AS l, {full('date_reference')} AS f,
      (coalesce(beneficiary, '') <> '')::int + (coalesce(summary, '') <> '')::int + (coalesce(disposition_type, '') <> '')::int + (coalesce(legal_type, '') <> '')::int
        + (coalesce(action_note, '') <> '')::int AS filled FROM records))""",
    "records",
)
stars("record_stars", "star_items")
oracle(
    "dedup_deeds",
    """SELECT case_id, servitut_id, date_reference, group_size FROM (SELECT i.*, count(*) OVER (PARTITION BY i.case_id, centre) AS group_size,
    row_number() OVER (PARTITION BY i.case_id, centre ORDER BY filled DESC, confidence DESC, i.ord) AS rn FROM star_items i JOIN record_stars s USING (case_id, ord)) WHERE rn = 1""",
    "star_items",
    "record_stars",
)

# ---- reuse, templates, files --------------------------------------------------------------------------------------
oracle(
    "stream_reuse",
    f"""SELECT document_id, count(*) AS pages, sum(length(text))::bigint AS chars, 0 AS batch FROM raw_pages GROUP BY 1
  UNION ALL SELECT document_id, count(*), sum(length(text || ' rettet'))::bigint, 1 FROM raw_pages WHERE {NUM} % 3 = 0 GROUP BY 1""",
    "raw_pages",
)
CHUNK_BLOCK = "'[Dok: ' || c.document_id || ' | Side ' || c.page::varchar || ' | Chunk ' || c.chunk_index::varchar || ']' || chr(10) || c.text"
BETWEEN = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
oracle(
    "document_prompts",
    f"""SELECT document_id, document_type AS source_type, CASE document_type WHEN 'akt' THEN 4096 ELSE 16000 END AS max_tokens, sha256(prompt) AS digest, length(prompt) AS chars
  FROM (SELECT document_id, document_type, CASE document_type WHEN 'akt' THEN 'Alm: ' ELSE 'Attest: ' END || string_agg({CHUNK_BLOCK}, {BETWEEN} ORDER BY page, chunk_index) AS prompt
        FROM chunks c JOIN documents_meta m USING (case_id, document_id) GROUP BY 1, 2)""",
    "chunks",
    "documents_meta",
)
oracle(
    "segment_prompts",
    f"""SELECT segment_id, 16000 AS max_tokens, sha256('Attest: ' || string_agg({CHUNK_BLOCK}, {BETWEEN} ORDER BY page, chunk_index)) AS digest
  FROM (SELECT *, unnest(page_numbers) AS page FROM segments) s JOIN chunks c USING (case_id, document_id, page) GROUP BY segment_id""",
    "segments",
    "chunks",
)
oracle(
    "documents_with_pages",
    """SELECT document_id, filename, page_number FROM documents_meta LEFT JOIN raw_pages USING (case_id, document_id)
  UNION ALL SELECT 'tom-' || pos::varchar, filename, NULL FROM documents_meta
  UNION ALL SELECT document_id || '!', filename, NULL FROM documents_meta UNION ALL SELECT 'tom-' || pos::varchar || '!', filename, NULL FROM documents_meta""",
    "documents_meta",
    "raw_pages",
)
oracle(
    "entity_files",
    """SELECT document_id, filename, pos FROM documents_meta WHERE pos % 9 <> 4 UNION ALL SELECT 'unreadable', NULL, count(*) FROM documents_meta WHERE pos % 9 = 4""",
    "documents_meta",
)
oracle(
    "evaluation_dump",
    "SELECT servitut_id, date_reference, akt_nr, title, confidence, array_to_string(applies_to_matrikler, '|') AS applies FROM canonicals",
    "canonicals",
)
oracle(
    "drop_register",
    """SELECT case_id, r.records, s.states FROM (SELECT case_id, count(*) AS records FROM canonicals GROUP BY 1) r FULL JOIN (SELECT case_id, count(*) AS states FROM seg_state GROUP BY 1) s USING (case_id)
  WHERE NOT regexp_matches(case_id, '-[13]$')""",
    "canonicals",
    "seg_state",
)
oracle(
    "bucketed_pages",
    """SELECT case_id, document_id, CASE WHEN pos % 5 = 2 THEN 'ny-' ELSE '' END || filename AS filename, count(*) AS pages, sum(length(text))::bigint AS chars
  FROM documents_meta JOIN raw_pages USING (case_id, document_id) GROUP BY ALL""",
    "documents_meta",
    "raw_pages",
)
oracle("document_lookup", "SELECT document_id, page_number, length(text) AS chars FROM raw_pages WHERE document_id = 'doc-7'", "raw_pages")
