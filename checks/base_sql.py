"""DuckDB forms of the derived tables, kept as named CTEs that oracles pull in by name."""

from __future__ import annotations

from deedloom.sources.fixtures import ADMIN_LINE

CASE = "'case-' || lang || '-' || (doc_id % 5)::varchar"


def ref(k: str) -> str:
    return (
        f"'0' || ({k} % 9 + 1)::varchar || '.02.19' || (50 + {k} % 40)::varchar || '-' || (100 + {k} % 13)::varchar || '-40'"
    )


NL = "chr(10)"
BLANK = r"\s\x1c-\x1f\x{85}\p{Z}"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body, needs)


def build(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(CTES[n][0] if CTES[n][0].startswith(n) else f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order)
    return f"WITH RECURSIVE {head}\n{select}" if order else select


def sentence(words: int) -> str:
    """The shortest whole sentence with at least that many words."""
    pattern = " +".join(["[^ ]+"] * words)
    return (
        "list_sort([{'n': length(x), 'x': x} FOR x IN [trim(y) FOR y IN string_split(replace(text, chr(10), ' '), '.')] "
        f"IF regexp_matches(x, '{pattern}')])[1].x"
    )


cte(
    "raw_pages",
    f"""
 SELECT {CASE} AS case_id, 'doc-' || doc_id::varchar AS document_id, page_number,
   CASE WHEN doc_id % 10 = 0 AND page_number = 1 THEN
        'Landsejerlav:  Vejle' || chr(9) || 'Markjorder ' || {NL} || 'Matrikelnummer: 000' || (doc_id % 7 + 1)::varchar || 'A' || {NL} ||
        'Areal: ' || (200 + doc_id % 50)::varchar || ' m2' || {NL} || {NL} || {NL} ||
        'Landsejerlav: Skibet By' || {NL} || 'Matrikelnummer: ' || (doc_id % 9 + 1)::varchar || 'a' || {NL} || 'Areal: 77 m2' ||
        chr(13) || {NL} || chr(13) || {NL} || body
        WHEN doc_id % 50 = 7 AND page_number = 1 THEN '{ADMIN_LINE} ' || body
        WHEN (doc_id + page_number) % 3 = 0 THEN body || {NL} || {NL} || 'Deklaration tinglyst ' || {ref('doc_id')} ||
             ' akt 40 F ' || (doc_id % 13)::varchar || {NL} || {NL} || 'Vedr. matr.nr. ' || (doc_id % 9 + 1)::varchar || 'a'
        ELSE body END AS text
 FROM (SELECT *, max(page_number) OVER (PARTITION BY doc_id) AS n FROM (
       SELECT doc_id, lang, pos // 6 + 1 AS page_number, string_agg(line, {NL} || {NL} ORDER BY pos) AS body
       FROM (SELECT doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos
             FROM (SELECT doc_id, lang, string_split(text, {NL}) AS l FROM documents))
       GROUP BY doc_id, lang, pos // 6 + 1))
 UNION ALL
 SELECT {CASE} AS case_id, 'doc-' || doc_id::varchar AS document_id, lines // 6 + 1 + unnest(range(1, len(more) + 1)) AS page_number, unnest(more) AS text
 FROM (SELECT doc_id, lang, len(string_split(text, {NL})) - 1 AS lines,
         CASE WHEN doc_id % 11 = 0 THEN [''] ELSE [] END || CASE WHEN doc_id % 7 = 0 THEN ['## 17 -- xy .. --'] ELSE [] END AS more
       FROM documents)""",
)

STRIP_SET = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(8239) || chr(12288)"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP_SET})"


cte(
    "clean_pages",
    f"""
 SELECT case_id, document_id, page_number,
   {strip("regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")} AS text
 FROM raw_pages""",
    "raw_pages",
)

cte(
    "quality_pages",
    r"""
 SELECT *, CASE WHEN length(text) > 0 THEN round(least(1.0, greatest(0.0,
     (length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) / length(text) - 0.10) / 0.40)), 3) ELSE 0.0 END::double AS confidence
 FROM clean_pages""",
    "clean_pages",
)

cte(
    "documents_meta",
    f"""
 SELECT {CASE} AS case_id, 'doc-' || doc_id::varchar AS document_id,
   CASE WHEN doc_id % 10 = 0 THEN 'Tinglysningsattest-' || doc_id::varchar || '.pdf' ELSE source || '-' || doc_id::varchar || '.pdf' END AS filename,
   CASE WHEN doc_id % 10 = 0 THEN 'tinglysningsattest' ELSE 'akt' END AS document_type,
   CASE WHEN doc_id % 14 = 0 THEN ' AKT ' WHEN doc_id % 20 = 0 THEN 'Tinglysningsattest' END AS requested_type,
   CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'error' ELSE 'ocr_done' END AS parse_status,
   (n_chars // 1800 + 1)::int AS page_count,
   (CASE WHEN doc_id % 5 > 2 THEN n_chars // 1500 + 1 ELSE 0 END)::int AS chunk_count,
   doc_id AS pos
 FROM documents""",
)

cte(
    "canonicals",
    f"""
 SELECT {CASE} AS case_id, doc_id AS ord, 'srv-' || doc_id::varchar AS servitut_id, 'doc-' || doc_id::varchar AS source_document,
   CASE WHEN doc_id % 28 = 0 THEN NULL
        WHEN doc_id % 20 = 0 THEN (doc_id % 9 + 1)::varchar || '/2 19' || (50 + doc_id % 40)::varchar
        WHEN doc_id % 36 = 0 THEN 'Deklaration fra 19' || (50 + doc_id % 40)::varchar
        ELSE {ref('doc_id')} END AS date_reference,
   CASE WHEN doc_id % 24 = 0 THEN NULL WHEN doc_id % 44 = 0 THEN 'F-4' ELSE '40 F ' || (doc_id % 13)::varchar END AS akt_nr,
   {sentence(3)} AS title,
   CASE WHEN doc_id % 16 = 0 THEN []::varchar[] ELSE [(doc_id % 9 + 1)::varchar || 'A'] END AS applies_to_matrikler,
   NULL::varchar AS summary,
   CASE WHEN doc_id % 8 = 0 THEN 'Vejle Amt' END AS beneficiary,
   CASE WHEN doc_id % 16 = 0 THEN NULL ELSE 'attest-linje' END AS raw_scope_text,
   ((doc_id % 10) / 10.0)::double AS confidence
 FROM documents""",
)

cte(
    "deed_items",
    f"""
 SELECT {CASE} AS case_id, doc_id AS ord, 'item-' || doc_id::varchar AS item_id, 'doc-' || doc_id::varchar AS document_id,
   CASE doc_id % 6 WHEN 0 THEN {ref('k')}
        WHEN 1 THEN (k % 9 + 1)::varchar || '.2.19' || (50 + k % 40)::varchar
        WHEN 2 THEN 'tinglyst 19' || (50 + k % 40)::varchar
        WHEN 3 THEN {ref('doc_id')}
        WHEN 4 THEN NULL
        ELSE '0' || (k % 9 + 1)::varchar || '.02.19' || (50 + k % 40)::varchar END AS date_reference,
   CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 17 = 1 THEN 'B-77' ELSE '40-F ' || (doc_id % 16)::varchar END AS akt_nr,
   {sentence(4)} AS title,
   CASE WHEN doc_id % 5 < 3 THEN {sentence(8)} END AS summary,
   CASE WHEN doc_id % 7 < 4 THEN 'Kommunen' END AS beneficiary,
   CASE WHEN doc_id % 11 < 6 THEN 'tilstand' END AS disposition_type,
   CASE WHEN doc_id % 13 < 6 THEN 'privatretlig' END AS legal_type,
   CASE WHEN doc_id % 9 < 3 THEN 'Ingen' END AS action_note,
   CASE WHEN doc_id % 10 = 0 THEN []::varchar[] ELSE [(doc_id % 9 + 1)::varchar || 'b'] END AS applies_to_matrikler,
   ((doc_id % 8) / 8.0)::double AS confidence
 FROM (SELECT *, doc_id - doc_id % 4 AS k FROM documents)""",
)

cte(
    "records",
    """
 SELECT 'srv-' || l_orderkey::varchar || '-' || l_linenumber::varchar || '-' || l_partkey::varchar || '-' || l_suppkey::varchar AS servitut_id,
   'case-' || (o_custkey % 10)::varchar AS case_id, 'doc-' || (l_orderkey % 200)::varchar AS source_document,
   CASE WHEN l_linenumber = 1 THEN 'attest' ELSE 'akt' END AS scope_source,
   CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 'uden dato'
        ELSE strftime(l_shipdate, '%d.%m.%Y') || '-' || (l_orderkey % 7 + 1)::varchar || '-' || l_suppkey::varchar END AS date_reference,
   CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE l_shipdate::date END AS registered_at,
   l_suppkey::varchar || ' ' || substr('ABCDEFGH', (l_partkey % 8)::int + 1, 1) || ' ' || (l_partkey % 50)::varchar AS akt_nr,
   p_name AS title, CASE WHEN l_returnflag = 'N' THEN NULL ELSE p_type END AS summary,
   CASE l_linestatus WHEN 'O' THEN 'Vejle Amt' ELSE NULL END AS beneficiary,
   CASE WHEN l_partkey % 3 = 0 THEN 'tilstand' END AS disposition_type,
   CASE WHEN l_partkey % 5 = 0 THEN 'privatretlig' END AS legal_type,
   CASE WHEN l_partkey % 7 = 0 THEN 'Opslag | notat' END AS action_note,
   CASE l_partkey % 4 WHEN 0 THEN 'rød' WHEN 1 THEN 'orange' WHEN 2 THEN 'sort' END AS byggeri_markering,
   CASE WHEN l_partkey % 11 = 0 THEN []::varchar[]
        ELSE [lpad((l_partkey % 40)::varchar, 4, '0') || substr('abcdefgh', (l_partkey % 8)::int + 1, 1), (l_suppkey % 40)::varchar || 'C'] END AS applies_to_matrikler,
   l_linenumber <> 3 AS attest_confirmed, round(l_discount * 10, 2) AS confidence,
   'doc-' || (l_orderkey % 200)::varchar AS ev1_document, p_name AS ev1_text, 'c' || l_partkey::varchar AS ev1_chunk, l_linenumber::int AS ev1_page,
   'doc-' || (l_partkey % 200)::varchar AS ev2_document, p_type || ' ' || p_name AS ev2_text, 'd' || l_suppkey::varchar AS ev2_chunk, (l_partkey % 9)::int AS ev2_page
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)

cte(
    "record_cases",
    """
 SELECT 'case-' || k::varchar AS case_id, 'Sag ' || k::varchar AS name,
   CASE WHEN k = 3 THEN []::varchar[] WHEN k % 2 = 0 THEN ['0001b', '7C', '12 e'] ELSE ['0004E', '0009c'] END AS target_matrikler,
   CASE WHEN k % 5 = 0 THEN []::varchar[] ELSE ['0001b', '7c', '12e', '4e', '9c', '20e', '33b'] END AS available_matrikler,
   CASE k % 4 WHEN 0 THEN 'created' WHEN 1 THEN 'parsing' WHEN 2 THEN 'extracting' ELSE 'done' END AS status, k AS pos
 FROM (SELECT DISTINCT o_custkey % 10 AS k FROM orders)""",
)

cte(
    "register_documents",
    """
 SELECT DISTINCT 'case-' || (o_custkey % 10)::varchar AS case_id, 'doc-' || (o_orderkey % 200)::varchar AS document_id
 FROM orders WHERE (o_orderkey % 200) % 10 = 0""",
)

cte(
    "file_manifest",
    f"""
 SELECT {CASE} AS case_id, 'doc-' || lpad(doc_id::varchar, 9, '0') || again || CASE WHEN doc_id % 9 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.pdf' END AS name,
   text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id % 500)::int) AS modified_at, doc_id
 FROM (SELECT *, unnest(CASE WHEN doc_id % 6 = 5 THEN ['', '-kopi'] ELSE [''] END) AS again FROM documents)""",
)

_ITEM = (
    "'{\"date_reference\": \"' || (doc_id % 9 + 1)::varchar || '.2.19' || (50 + doc_id % 40)::varchar || "
    "'\", \"akt_nr\": ' || CASE WHEN doc_id % 4 = 1 THEN 'null' ELSE '\" 40 F ' || (doc_id % 13)::varchar || '\"' END || "
    "', \"title\": \"' || replace(source, 'src', 'Titel ') || '\", \"registered_at\": ' || "
    "CASE WHEN doc_id % 3 = 0 THEN '\"1968-05-01T00:00\"' ELSE 'null' END || "
    "', \"applies_to_matrikler\": ' || CASE doc_id % 3 WHEN 0 THEN '[\"1A\", \" 2b \", \"\"]' WHEN 1 THEN '\" 7C \"' ELSE 'null' END || "
    "', \"confidence\": ' || CASE doc_id % 4 WHEN 0 THEN '\"0.9\"' WHEN 1 THEN '0' WHEN 2 THEN 'null' ELSE '0.25' END || '}'"
)
cte(
    "answers",
    f"""
 SELECT {CASE} AS case_id, 'doc-' || doc_id::varchar AS document_id,
   CASE doc_id % 8 WHEN 0 THEN '[' || item || ', ' || replace(item, 'Titel', 'Anden') || ']'
     WHEN 1 THEN '{{"items": [' || item || ']}}'
     WHEN 2 THEN 'Her er svaret:' || {NL} || '```json' || {NL} || '[' || item || ']' || {NL} || '```' || {NL} || 'Slut.'
     WHEN 3 THEN 'Fundet: [' || item || '] som ønsket.'
     WHEN 4 THEN '  ' || item || '  '
     WHEN 5 THEN '[]'
     WHEN 6 THEN 'Ingen fund i ' || source
     ELSE 'Svar {{"matches": "x", "results": [' || item || ', ' || item || ', ' || item || ']}} slut' END AS response_text
 FROM (SELECT *, {_ITEM} AS item FROM documents)""",
)
