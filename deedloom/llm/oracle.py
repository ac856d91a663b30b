"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from deedloom.llm import license_scan, url_filter

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _p(s: str) -> str:
    m, a = f"{url_filter.PRIOR}::DOUBLE", url_filter.A
    first = f"(({s}1 + {m} / {a}) / ({s}n1 + {m}))"
    second = f"(({s}2 + {m} * {first}) / ({s}n2 + {m}))"
    return f"(({s} + {m} * {second}) / ({s}n3 + {m}))"


def url_filter_sql() -> str:
    a, rules = url_filter.A, ", ".join(f"({i}, '{x}', '{h}', '{p}')" for i, (x, h, p) in enumerate(url_filter.RULES))
    side = "(sum(g) OVER ({w}))::DOUBLE AS g{n}, (sum(b) OVER ({w}))::DOUBLE AS b{n}"
    over = ", ".join(
        side.format(w=w, n=n)
        for w, n in (("PARTITION BY c3", "1"), ("PARTITION BY c2, c3", "2"), ("", "n1"), ("PARTITION BY c2", "n2"), ("PARTITION BY c1, c2", "n3"))
    )
    return f"""
WITH given AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, page_id, coalesce(contains('{url_filter.HELD}', md5(url)[1]), false) AS held,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hp AS MATERIALIZED (
  SELECT rid, page_id, rest, held, translate(regexp_extract(rest, '^[^/?#]*'), '{LETTERS}', '{LETTERS.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM given),
rules(ord, act, rhost, rpath) AS (VALUES {rules}),
ruled AS MATERIALIZED (
  SELECT rid, arg_min(act, rank) AS act, arg_min(rhost || rpath, rank) AS rule FROM (
    SELECT rid, act, rhost, rpath, ord - 100 * length(rhost || rpath) AS rank FROM hp JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
  GROUP BY rid),
chars AS (SELECT rid, translate(rest, '{LETTERS}', '{LETTERS.lower()}') AS s FROM hp),
coded AS (
  SELECT rid, [0, 0] || [CASE WHEN contains('0123456789', substr(s, i, 1)) THEN 2
    WHEN contains('{url_filter.SIGNS}{LETTERS.lower()}', substr(s, i, 1)) THEN strpos('{url_filter.SIGNS}{LETTERS.lower()}', substr(s, i, 1)) + 2
    ELSE 1 END FOR i IN range(1, length(s) + 1)] AS syms
  FROM chars),
cells AS MATERIALIZED (
  SELECT rid, unnest([(syms[i - 2] * {a} + syms[i - 1]) * {a} + syms[i] FOR i IN range(3, len(syms) + 1)]) AS cell FROM coded),
counted AS (
  SELECT cell, count(*) FILTER (act = 'allow') AS g, count(*) FILTER (act = 'block') AS b FROM cells JOIN ruled USING (rid) JOIN hp USING (rid)
  WHERE NOT held GROUP BY cell),
every AS (
  SELECT cell, cell // {a * a} AS c1, cell // {a} % {a} AS c2, cell % {a} AS c3, coalesce(g, 0)::DOUBLE AS g, coalesce(b, 0)::DOUBLE AS b
  FROM range({a**3}) t(cell) LEFT JOIN counted USING (cell)),
summed AS (SELECT cell, g, b, {over} FROM every),
model AS MATERIALIZED (
  SELECT cell, CASE WHEN gn1 = 0 OR bn1 = 0 THEN 0 ELSE round({url_filter.SCALE} * (ln({_p('g')}) - ln({_p('b')})))::BIGINT END AS lr FROM summed),
totals AS (SELECT rid, sum(lr)::DOUBLE AS total, count(*) AS n FROM cells JOIN model USING (cell) GROUP BY rid),
scored AS MATERIALIZED (
  SELECT hp.* EXCLUDE (rest), rule, act, CASE WHEN n > 0 THEN floor(total / n) / {url_filter.SCALE} ELSE 0.0::DOUBLE END AS score
  FROM hp LEFT JOIN ruled USING (rid) LEFT JOIN totals USING (rid)),
steps AS (
  SELECT floor(score * {url_filter.SCALE} / {url_filter.STEP})::BIGINT AS step, count(*) FILTER (act = 'allow') AS g, count(*) FILTER (act = 'block') AS b
  FROM scored WHERE act IS NOT NULL AND held GROUP BY step),
sums AS (
  SELECT step, sum(g) OVER () AS good, sum(b) OVER () AS bad, sum(g) OVER (ORDER BY step) - g AS lost, sum(b) OVER (ORDER BY step) - b AS caught,
    lag(step) OVER (ORDER BY step) AS before
  FROM steps),
best AS (
  SELECT CASE WHEN before IS NULL THEN step ELSE floor((before + 1 + step) / 2) END AS cut_at FROM sums WHERE good > 0 AND bad > 0
  ORDER BY (good - lost) * bad + caught * good DESC, step LIMIT 1),
least_score AS (SELECT coalesce(max(cut_at) * {url_filter.STEP} / {url_filter.SCALE}, '-infinity'::DOUBLE) AS t FROM best)
SELECT page_id, host, path, rule, coalesce(act, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, score
FROM scored, least_score
"""


def license_scan_sql() -> str:
    cols = ", ".join(f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', {r[4]}, {r[5]})" for i, r in enumerate(license_scan.rules()))
    before, after = license_scan.BEFORE, license_scan.AFTER
    spaced = "CASE WHEN len({s}) > 0 THEN ' ' || array_to_string({s}, ' ') || ' ' ELSE ' ' END"
    left, right = f"w[greatest(1, i - {before}):i - 1]", f"w[i + 1:i + {after}]"
    return rf"""
WITH rules(rid, label, key, before, after, priority, base) AS (VALUES {cols}),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
spots AS (
  SELECT d, i - 1 AS i, key, {spaced.format(s=left)} AS l, {spaced.format(s=right)} AS r
  FROM (SELECT d, w, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS key FROM docs) WHERE key IN (SELECT key FROM rules)),
found AS MATERIALIZED (
  SELECT d, label, priority, base, i - (len(regexp_extract(l, before)) - len(replace(regexp_extract(l, before), ' ', '')) - 1) AS a,
    i + 1 + len(regexp_extract(r, after)) - len(replace(regexp_extract(r, after), ' ', '')) - 1 AS z
  FROM spots JOIN rules USING (key) WHERE regexp_matches(l, before) AND regexp_matches(r, after)),
kept AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found e WHERE e.d = f.d AND e.a <= f.a AND e.z >= f.z
      AND (e.priority > f.priority OR e.priority = f.priority AND e.z - e.a > f.z - f.a))),
based AS (
  SELECT d, count(*) AS n, min(a) AS first_word, max(a) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM found WHERE base GROUP BY d),
named AS (
  SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT d, label FROM kept WHERE label <> '' UNION SELECT d, label FROM found WHERE base) GROUP BY d),
best AS (SELECT d, max(priority) AS p FROM kept WHERE label <> '' GROUP BY d)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(based.labels, '') AS base_labels,
  coalesce(named.labels, '') AS labels, coalesce(p, 0)::DOUBLE / 100 AS score
FROM docs LEFT JOIN based USING (d) LEFT JOIN named USING (d) LEFT JOIN best USING (d)
"""


WARC_SQL = """
WITH paid AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
firsts AS (SELECT d, min(page_id) AS first FROM paid WHERE n >= 100 GROUP BY d HAVING count(*) > 1),
marked AS (
  SELECT page_id, n, paid.d, first, coalesce(first IS NOT NULL AND (page_id IS NULL OR page_id > first), false) AS again
  FROM paid LEFT JOIN firsts USING (d))
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM marked
"""

DECONTAMINATE_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
spots AS (
  SELECT d, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT d, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs JOIN (SELECT DISTINCT k FROM wins) ON len(w) >= k)),
found AS MATERIALIZED (SELECT d, i, spots.k, item_id FROM spots JOIN wins USING (k, g)),
hit AS (SELECT d, count(DISTINCT p) AS n FROM (SELECT d, unnest(range(i, i + k)) AS p FROM found) GROUP BY d),
listed AS (
  SELECT d, count(DISTINCT item_id) AS n, coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '') AS ids FROM found GROUP BY d)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (d) LEFT JOIN listed USING (d)
"""

FILL_MIDDLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
    ('0x' || h[17:24])::BIGINT % 100 AS u, ('0x' || h[25:32])::BIGINT % 100 AS v
  FROM hashed),
formed AS (
  SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR u >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256
FROM cut
"""

TOP_K_SQL = """
WITH given AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r AS qr, q.vec_id AS query_id, d.vec_id, d.r,
    coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM given q JOIN given d ON q.r <> d.r WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM pairs)
WHERE rank <= 20
"""

COLLOCATIONS_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
listed AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM listed, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, size, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:size], ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS c FROM cand)),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
spans AS (SELECT lang, a, w, size, len, unnest(range(1, size - len + 2)) AS i FROM cand, (VALUES (2), (3)) t(len) WHERE len < size),
cover AS (SELECT lang, array_to_string(w[i:i + len - 1], ' ') AS phrase, max(a) AS most FROM spans GROUP BY ALL),
free AS (
  SELECT best.* FROM best LEFT JOIN cover USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {
    "op2_warc": WARC_SQL, "op3_decontaminate": DECONTAMINATE_SQL, "op4_license_scan": license_scan_sql(), "op5_url_filter": url_filter_sql(),
    "op11_fill_middle": FILL_MIDDLE_SQL, "op12_top_k": TOP_K_SQL, "op13_collocations": COLLOCATIONS_SQL,
}
