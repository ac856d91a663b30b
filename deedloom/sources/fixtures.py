"""Tables of the record model, derived with Spark from the TPC-H-like test tables.

The test tables hold invented prose without register terms, so dates, archive ids and parcels are
injected deterministically. Everything here is a projection of the whole input: no samples, no caps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deedloom import fixed

PAGE_LINES = 6
# a cover line that the administrative page pattern knows
ADMIN_LINE = "DSS 41207755 19_BR-C 08 Bulk Sort / Hvid"
SPREAD_BY = {"documents": "doc_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table. A single small file would keep all work in one task, so it is spread by key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = SPREAD_BY.get(name)
    wanted = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() * 2 <= wanted:
        df = df.repartition(wanted, key)
    return df


def _case() -> str:
    return "concat('case-', lang, '-', cast(doc_id % 5 as string))"


def _reference(key: str) -> str:
    return (
        f"concat('0', cast({key} % 9 + 1 as string), '.02.19', cast(50 + {key} % 40 as string), '-', "
        f"cast(100 + {key} % 13 as string), '-40')"
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: six source lines each, with register terms added; some documents get a blank or a poor page more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.split("text", "\n").alias("l"))
    bodies = F.expr(
        f"transform(sequence(0, cast((size(l) - 1) div {PAGE_LINES} as int)), "
        f"i -> array_join(slice(l, i * {PAGE_LINES} + 1, {PAGE_LINES}), '\\n\\n'))"
    )
    none = "cast(array() as array<string>)"
    more = F.expr(f"concat(if(doc_id % 11 = 0, array(''), {none}), if(doc_id % 7 = 0, array('## 17 -- xy .. --'), {none}))")
    whole = docs.select("doc_id", "lang", bodies.alias("b")).withColumns({"n": F.size("b"), "b": F.concat("b", more)})
    pages = whole.select("doc_id", "lang", "n", F.posexplode("b").alias("p", "body")).withColumn("page_number", F.col("p") + 1)
    return pages.selectExpr(
        f"{_case()} as case_id",
        "concat('doc-', cast(doc_id as string)) as document_id",
        "page_number",
        f"""case
          when page_number > n then body
          when doc_id % 10 = 0 and page_number = 1 then concat(
            'Landsejerlav:  Vejle\\tMarkjorder \\nMatrikelnummer: 000', cast(doc_id % 7 + 1 as string), 'A\\n',
            'Areal: ', cast(200 + doc_id % 50 as string), ' m2\\n\\n\\n',
            'Landsejerlav: Skibet By\\nMatrikelnummer: ', cast(doc_id % 9 + 1 as string), 'a\\nAreal: 77 m2\\r\\n\\r\\n', body)
          when doc_id % 50 = 7 and page_number = 1 then concat('{ADMIN_LINE} ', body)
          when (doc_id + page_number) % 3 = 0 then concat(body, '\\n\\n', 'Deklaration tinglyst ', {_reference('doc_id')},
             ' akt 40 F ', cast(doc_id % 13 as string), '\\n\\n', 'Vedr. matr.nr. ', cast(doc_id % 9 + 1 as string), 'a')
          else body end as text""",
    )


def _sentence(words: int) -> str:
    """The shortest whole sentence of the text with at least that many words; null if there is none."""
    pattern = " +".join(["[^ ]+"] * words)
    return (
        f"array_min(transform(filter(transform(split(replace(text, '\\n', ' '), '[.]'), x -> trim(x)), x -> x rlike '{pattern}'), "
        "x -> named_struct('n', length(x), 'x', x))).x"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document metadata; every tenth document is a register extract."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"{_case()} as case_id",
        "concat('doc-', cast(doc_id as string)) as document_id",
        "case when doc_id % 10 = 0 then concat('Tinglysningsattest-', cast(doc_id as string), '.pdf') "
        "else concat(source, '-', cast(doc_id as string), '.pdf') end as filename",
        "case when doc_id % 10 = 0 then 'tinglysningsattest' else 'akt' end as document_type",
        "case when doc_id % 14 = 0 then ' AKT ' when doc_id % 20 = 0 then 'Tinglysningsattest' end as requested_type",
        "case doc_id % 5 when 0 then 'pending' when 1 then 'processing' when 2 then 'error' else 'ocr_done' end as parse_status",
        "cast(n_chars div 1800 + 1 as int) as page_count",
        "cast(case when doc_id % 5 > 2 then n_chars div 1500 + 1 else 0 end as int) as chunk_count",
        "doc_id as pos",
    )


def canonicals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register records in list order (`ord`), one per document, some without date or archive id."""
    return table(spark, sf_dir, "documents").selectExpr(
        f"{_case()} as case_id",
        "doc_id as ord",
        "concat('srv-', cast(doc_id as string)) as servitut_id",
        "concat('doc-', cast(doc_id as string)) as source_document",
        f"""case when doc_id % 28 = 0 then cast(null as string)
               when doc_id % 20 = 0 then concat(cast(doc_id % 9 + 1 as string), '/2 19', cast(50 + doc_id % 40 as string))
               when doc_id % 36 = 0 then concat('Deklaration fra 19', cast(50 + doc_id % 40 as string))
               else {_reference('doc_id')} end as date_reference""",
        "case when doc_id % 24 = 0 then cast(null as string) when doc_id % 44 = 0 then 'F-4' "
        "else concat('40 F ', cast(doc_id % 13 as string)) end as akt_nr",
        f"{_sentence(3)} as title",
        "case when doc_id % 16 = 0 then array() else array(concat(cast(doc_id % 9 + 1 as string), 'A')) end as applies_to_matrikler",
        "cast(null as string) as summary",
        "case when doc_id % 8 = 0 then 'Vejle Amt' end as beneficiary",
        "case when doc_id % 16 = 0 then cast(null as string) else 'attest-linje' end as raw_scope_text",
        "cast((doc_id % 10) / 10.0 as double) as confidence",
    )


def deed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read from deeds, in arrival order (`ord`), pointing at nearby register records in several spellings."""
    near = table(spark, sf_dir, "documents").selectExpr("*", "doc_id - doc_id % 4 as k")
    return near.selectExpr(
        f"{_case()} as case_id",
        "doc_id as ord",
        "concat('item-', cast(doc_id as string)) as item_id",
        "concat('doc-', cast(doc_id as string)) as document_id",
        f"""case doc_id % 6 when 0 then {_reference('k')}
               when 1 then concat(cast(k % 9 + 1 as string), '.2.19', cast(50 + k % 40 as string))
               when 2 then concat('tinglyst 19', cast(50 + k % 40 as string))
               when 3 then {_reference('doc_id')}
               when 4 then cast(null as string)
               else concat('0', cast(k % 9 + 1 as string), '.02.19', cast(50 + k % 40 as string)) end as date_reference""",
        "case when doc_id % 3 = 0 then cast(null as string) when doc_id % 17 = 1 then 'B-77' "
        "else concat('40-F ', cast(doc_id % 16 as string)) end as akt_nr",
        f"{_sentence(4)} as title",
        f"case when doc_id % 5 < 3 then {_sentence(8)} end as summary",
        "case when doc_id % 7 < 4 then 'Kommunen' end as beneficiary",
        "case when doc_id % 11 < 6 then 'tilstand' end as disposition_type",
        "case when doc_id % 13 < 6 then 'privatretlig' end as legal_type",
        "case when doc_id % 9 < 3 then 'Ingen' end as action_note",
        "case when doc_id % 10 = 0 then array() else array(concat(cast(doc_id % 9 + 1 as string), 'b')) end as applies_to_matrikler",
        "cast((doc_id % 8) / 8.0 as double) as confidence",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked records at scale: one per lineitem row, case by customer group."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return joined.selectExpr(
        "concat('srv-', cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', "
        "cast(l_suppkey as string)) as servitut_id",
        "concat('case-', cast(o_custkey % 10 as string)) as case_id",
        "concat('doc-', cast(l_orderkey % 200 as string)) as source_document",
        "case when l_linenumber = 1 then 'attest' else 'akt' end as scope_source",
        """case when l_partkey % 29 = 0 then cast(null as string) when l_partkey % 31 = 0 then 'uden dato'
             else concat(date_format(l_shipdate, 'dd.MM.yyyy'), '-', cast(l_orderkey % 7 + 1 as string), '-',
                         cast(l_suppkey as string)) end as date_reference""",
        "case when l_partkey % 37 = 0 then cast(null as date) else cast(l_shipdate as date) end as registered_at",
        "concat(cast(l_suppkey as string), ' ', substr('ABCDEFGH', cast(l_partkey % 8 as int) + 1, 1), ' ', "
        "cast(l_partkey % 50 as string)) as akt_nr",
        "p_name as title",
        "case when l_returnflag = 'N' then cast(null as string) else p_type end as summary",
        "case l_linestatus when 'O' then 'Vejle Amt' else cast(null as string) end as beneficiary",
        "case when l_partkey % 3 = 0 then 'tilstand' end as disposition_type",
        "case when l_partkey % 5 = 0 then 'privatretlig' end as legal_type",
        "case when l_partkey % 7 = 0 then 'Opslag | notat' end as action_note",
        "case l_partkey % 4 when 0 then 'rød' when 1 then 'orange' when 2 then 'sort' end as byggeri_markering",
        """case when l_partkey % 11 = 0 then array()
             else array(concat(lpad(cast(l_partkey % 40 as string), 4, '0'), substr('abcdefgh', cast(l_partkey % 8 as int) + 1, 1)),
                        concat(cast(l_suppkey % 40 as string), 'C')) end as applies_to_matrikler""",
        "cast(l_linenumber <> 3 as boolean) as attest_confirmed",
        "round(l_discount * 10, 2) as confidence",
        """array(named_struct('chunk_id', concat('c', cast(l_partkey as string)), 'document_id',
                    concat('doc-', cast(l_orderkey % 200 as string)), 'page', cast(l_linenumber as int), 'text_excerpt', p_name),
              named_struct('chunk_id', concat('d', cast(l_suppkey as string)), 'document_id',
                    concat('doc-', cast(l_partkey % 200 as string)), 'page', cast(l_partkey % 9 as int), 'text_excerpt',
                    concat(p_type, ' ', p_name))) as evidence""",
    )


def record_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case of `records`: targets and known parcels."""
    cases = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 as k").distinct()
    return cases.selectExpr(
        "concat('case-', cast(k as string)) as case_id",
        "concat('Sag ', cast(k as string)) as name",
        """case when k = 3 then array() when k % 2 = 0 then array('0001b', '7C', '12 e')
             else array('0004E', '0009c') end as target_matrikler""",
        """case when k % 5 = 0 then array() else array('0001b', '7c', '12e', '4e', '9c', '20e', '33b') end as available_matrikler""",
        "case k % 4 when 0 then 'created' when 1 then 'parsing' when 2 then 'extracting' else 'done' end as status",
        "k as pos",
    )


def register_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register extracts among the documents that `records` cite."""
    ids = table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 as c", "o_orderkey % 200 as d").distinct()
    return ids.where("d % 10 = 0").selectExpr(
        "concat('case-', cast(c as string)) as case_id", "concat('doc-', cast(d as string)) as document_id"
    )


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an import folder with their whole content; every sixth file comes a second time under another name."""
    docs = table(spark, sf_dir, "documents").selectExpr("*", "explode(if(doc_id % 6 = 5, array('', '-kopi'), array(''))) as again")
    return docs.selectExpr(
        f"{_case()} as case_id",
        "concat('doc-', lpad(cast(doc_id as string), 9, '0'), again, case when doc_id % 9 = 0 then '.txt' when doc_id % 2 = 0 then '.PDF' else '.pdf' end) as name",
        "cast(text as binary) as content",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 500 as int)) as modified_at",
        "doc_id",
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored model answers: one per document, JSON wrapped in several ways."""
    item = (
        "concat('{\"date_reference\": \"', cast(doc_id % 9 + 1 as string), '.2.19', cast(50 + doc_id % 40 as string), "
        "'\", \"akt_nr\": ', case when doc_id % 4 = 1 then 'null' else concat('\" 40 F ', cast(doc_id % 13 as string), '\"') end, "
        "', \"title\": \"', replace(source, 'src', 'Titel '), '\", \"registered_at\": ', "
        "case when doc_id % 3 = 0 then '\"1968-05-01T00:00\"' else 'null' end, "
        "', \"applies_to_matrikler\": ', case doc_id % 3 when 0 then '[\"1A\", \" 2b \", \"\"]' when 1 then '\" 7C \"' else 'null' end, "
        "', \"confidence\": ', case doc_id % 4 when 0 then '\"0.9\"' when 1 then '0' when 2 then 'null' else '0.25' end, '}')"
    )
    return table(spark, sf_dir, "documents").selectExpr(
        f"{_case()} as case_id",
        "concat('doc-', cast(doc_id as string)) as document_id",
        f"""case doc_id % 8
             when 0 then concat('[', {item}, ', ', replace({item}, 'Titel', 'Anden'), ']')
             when 1 then concat('{{"items": [', {item}, ']}}')
             when 2 then concat('Her er svaret:\\n```json\\n[', {item}, ']\\n```\\nSlut.')
             when 3 then concat('Fundet: [', {item}, '] som ønsket.')
             when 4 then concat('  ', {item}, '  ')
             when 5 then '[]'
             when 6 then concat('Ingen fund i ', source)
             else concat('Svar {{"matches": "x", "results": [', {item}, ', ', {item}, ', ', {item}, ']}} slut') end as response_text""",
    )
