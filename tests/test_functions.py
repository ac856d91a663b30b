from pyspark.sql import functions as F

from deedloom.functions import dates as D, jsonx as J, parcels as P, sqlfuncs, text as T


def one(spark, value, expr, schema="string"):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    assert one(spark, " a\r\nb\rc\n\n\n\nd \t e ", T.clean_text) == "a\nb\nc\n\nd e"


def test_quality(spark):
    assert one(spark, "", T.text_quality) == 0.0
    assert one(spark, "Deklaration om færdselsret på matrikel 5a", T.text_quality) > 0.6
    assert one(spark, "## -- .. !! ab", T.text_quality) < 0.3
    assert one(spark, "abcd......", T.text_quality) == 0.75


def test_keywords(spark):
    assert one(spark, "Her er en DEKLARATION", T.has_keywords)
    assert not one(spark, "intet at se", T.has_keywords)
    assert one(spark, "servitut og lokalplan", lambda c: T.has_keywords(c, threshold=2))


def test_date_strings(spark):
    got = one(spark, "den 01.02.1950 og 1950-02-01, 03/04-1960 samt 5. maj 1970", T.date_strings)
    assert got == ["01.02.1950", "03/04-1960", "1950-02-01", "5. maj 1970"]


def test_heading_scope_and_parcels(spark):
    text = "abc\nServitutter\nDeklaration om vej\nVedr. matr.nr. 8BX og 0731k, 8bx"
    assert one(spark, text, T.heading) == "Deklaration om vej"
    assert one(spark, text, T.scope_line) == "Vedr. matr.nr. 8BX og 0731k, 8bx"
    assert one(spark, text, T.parcel_refs) == ["8bx", "0731k"]


def test_word_edges_know_danish_letters(spark):
    assert one(spark, "færdselsret på vej", lambda c: T.query_words(c)) == ["færdselsret", "vej"]
    assert one(spark, "Vejle Amt", T.has_amt) and not one(spark, "Kommunen", T.has_amt)
    assert not one(spark, "øamt", T.has_amt)


def test_keys(spark):
    assert one(spark, "71 K-208", T.archive_key) == "71k208"
    assert one(spark, "03.07.1948-551203-12", T.match_key) == "0307194855120312"
    assert one(spark, "Færdsel 1", T.merge_key) == "frdsel1"
    assert one(spark, "æøå", T.merge_key) is None


def test_ids_names_durations(spark):
    assert one(spark, "doc-abc", lambda c: T.chunk_id(c, F.lit(1), F.lit(0))) == "0bb116476921"
    assert one(spark, "Akt 2/x", T.filename_component) == "Akt_2-x"
    assert one(spark, " a<b>:c ", T.download_name) == "a_b__c"
    assert one(spark, 59, T.duration_label, "int") == "59s" and one(spark, 125, T.duration_label, "int") == "2m 5s"
    assert one(spark, "a|b\nc", T.markdown_cell) == "a\\|b c" and one(spark, "", T.markdown_cell) == "—"


def test_date_components(spark):
    got = one(spark, "3.7.1948-551203-12", D.date_components)
    assert (got.full_date, got.lob_suffix, got.year) == ("03.07.1948", "551203-12", "1948")
    got = one(spark, "5 / 2 1961", D.date_components)
    assert (got.full_date, got.lob_suffix, got.year) == (None, None, "1961")
    got = one(spark, "5/2/1961", D.date_components)
    assert (got.full_date, got.year) == ("05.02.1961", "1961")
    assert one(spark, "Deklaration 1850", D.date_components).year == "1850"


def test_registered_and_sort_date(spark):
    assert str(one(spark, "1968-05-01T00:00", lambda c: D.registered_at(c, F.lit(None).cast("string")))) == "1968-05-01"
    assert one(spark, "31.02.2000", lambda c: D.registered_at(c, c)) is None
    assert str(one(spark, "uden dato", D.sort_date)) == "9999-12-31"


def test_parcel_scope(spark):
    def scope(refs, targets, known=()):
        df = spark.createDataFrame([(refs, targets, list(known))], "r array<string>, t array<string>, k array<string>")
        return df.select(P.target_scope(P.parcel_keys("r"), P.parcel_keys("t"), P.parcel_keys("k")).alias("y")).first().y

    assert scope(["0731k"], ["0008bx"]) is False
    assert scope([], ["0008bx"]) is None
    assert scope(["42h"], ["0042h"]) is True
    assert scope(["17d"], ["0003s", "0003t"], ["0003s", "0017d"]) is False
    assert scope(["88q"], ["0003s"], ["0003s"]) is None
    assert scope(["1a"], []) is None
    df = spark.createDataFrame([(["3s", "3t"], ["0003s", "0003t"])], "r array<string>, t array<string>")
    assert df.select(P.matching_targets(P.parcel_keys("r"), P.spelled_targets("t")).alias("y")).first().y == ["0003s", "0003t"]


def test_parcel_blocks(spark):
    text = "Landsejerlav: By  Jorder\nMatrikelnummer: 0008BX\nAreal: 3000000000 m2\nLandsejerlav: X Matrikelnummer: 0731k Areal: 5 m2"
    got = one(spark, text, P.parcel_blocks)
    assert [(b.matrikelnummer, b.landsejerlav, b.areal_m2) for b in got] == [("0008bx", "By Jorder", 3000000000), ("0731k", "X", 5)]


def test_json_salvage(spark):
    size = lambda text: len(one(spark, text, J.answer_items))
    assert size('[{"title": "a"}, {"title": "b"}]') == 2
    assert size('Svar:\n```json\n{"servitutter": [{"title": "a"}]}\n```') == 1
    assert size('før {"title": "a"} efter') == 1
    assert size("[]") == 0 and size("intet") == 0
    # text after a value must not pass for the value alone
    assert one(spark, '{"a": 1} slut', J.strict_parse) is None
    assert one(spark, "[1]]", J.strict_parse) is None


def test_chat_text(spark):
    assert one(spark, '{"choices":[{"message":{"content":" hej "}}]}', J.chat_text) == "hej"
    assert one(spark, '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":"b"}]}}]}', J.chat_text) == "a\nb"
    assert one(spark, '{"choices":[]}', J.chat_text) is None


def test_sql_functions_are_the_column_functions(spark):
    texts = [
        "", " ", "\u2003\t", "it's 100 % \\ \"x\" \\d", " a\r\nb\u00a0\n\n\n\nd\te ", "abc\nServitutter\nDeklaration om vej\nVedr. matr.nr. 8BX og 0731k, 8bx",
        "DSS  12 x bulk sort", "den 01.02.1950-3-40 og 1950-02-01, 03/04-1960 samt 5. maj 1970, 123456-7", "1.2.1950-17-40", "2020-01-05T10", "31.02.1950", "uden 1968",
        "Landsejerlav:  Vejle\tBy \nMatrikelnummer: 0007A\nAreal: 77 m2\nLandsejerlav: Q\nMatrikelnummer: 9b\nAreal: 99999999999999999999 m2",
        "000 5AY", "0", "a|b\n", "x" * 400 + " servitut " + "y" * 400, " AKT ", "akt", "12", " 7 ", "-", "srv-" + "0" * 64, "Ærø/2:<*>?", "..a b..", "Vejle Amt",
    ]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "x string").withColumn("a", F.array("x", F.lit(" 007A"), F.lit(""), F.lit(None), "x"))
    sqlfuncs.register(spark)
    plain = {
        "clean_text": T.clean_text, "text_quality": T.text_quality, "archive_key": T.archive_key, "match_key": T.match_key, "merge_key": T.merge_key,
        "parcel_key": P.parcel_key, "has_amt": T.has_amt, "sort_date": D.sort_date, "has_keywords": T.has_keywords, "paragraphs": T.paragraphs,
        "date_strings": T.date_strings, "serial_numbers": T.serial_numbers, "is_admin_page": T.is_admin_page, "heading": T.heading, "scope_line": T.scope_line,
        "parcel_refs": T.parcel_refs, "starts_entry": T.starts_new_entry, "keyword_in_context": T.keyword_in_context, "parcel_blocks": P.parcel_blocks,
        "text_hash": T.text_hash, "date_components": D.date_components, "blank_to_null": T.blank_to_null, "query_words": lambda c: T.query_words(F.col(c)),
        "markdown_cell": T.markdown_cell, "download_name": T.download_name, "filename_part": T.filename_component, "short_id": T.short_id, "document_type": T.validated_type,
    }
    pairs = {n: (f"dl_{n}(x)", f("x")) for n, f in plain.items()}
    pairs |= {
        "first_matches": ("dl_first_matches(x, '[0-9]+')", T.first_matches("x", "[0-9]+")),
        "distinct_nonempty": ("dl_distinct_nonempty(a)", T.distinct_nonempty(F.col("a"))), "parcel_keys": ("dl_parcel_keys(a)", P.parcel_keys("a")),
        "registered_at": ("dl_registered_at(x, '1.2.1950')", D.registered_at("x", F.lit("1.2.1950"))), "excerpt": ("dl_excerpt(x, 3)", T.excerpt("x", 3)),
        "overlap": ("dl_overlap(x, a)", T.overlap_score(F.col("x"), F.col("a"))), "entity_id": ("dl_entity_id('srv-', x)", T.entity_id("srv-", F.col("x"))),
        "chunk_block": ("dl_chunk_block('d', 1, 2, x)", T.chunk_block(F.lit("d"), F.lit(1), F.lit(2), "x")),
        "duration": ("dl_duration_label(length(x))", T.duration_label(F.length("x"))), "int_or": ("dl_int_or(x, 10000)", F.coalesce(F.col("x").try_cast("int"), F.lit(10000))),
    }
    got = df.select("x", *[F.expr(s).alias(f"{n}_sql") for n, (s, _) in pairs.items()], *[c.alias(f"{n}_col") for n, (_, c) in pairs.items()]).collect()
    for r in got:
        # structs by place, as the SQL ones may be named by their type
        flat = lambda v: tuple(map(flat, v)) if isinstance(v, (list, tuple)) else v
        assert [n for n in pairs if flat(r[f"{n}_sql"]) != flat(r[f"{n}_col"])] == [], r.x


def test_sql_functions_of_answers(spark):
    bodies = [
        "", "[]", "x", '[1, {"a": 2}] tail', '```json\n[{"title": "a"}, {"title": "b"}]\n```', 'so {"items": [], "data": [3]} end', '{"title": "one"}', '{"other": 1}', "```[]``` [4]", "[1] [2]", None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, x string")
    df.createOrReplaceTempView("_bodies")
    sqlfuncs.register(spark)
    want = df.select("id", F.posexplode(J.answer_items("x")).alias("pos", "item")).select("id", "pos", F.to_json("item")).collect()
    got = spark.sql("SELECT id, pos, to_json(item) FROM _bodies, LATERAL dl_answer_items(x) AS i").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 5
    values = ['{"v": [" A ", null, ""]}', '{"v": " B "}', '{"v": " "}', '{"v": 3}', '{"v": true}', '{"v": null}', "{}"]
    v = spark.createDataFrame([(x,) for x in values], "x string").select(F.parse_json("x").alias("v"))
    one = "try_variant_get(v, '$.v', 'variant')"
    rows = v.select(
        F.expr(f"dl_text_list({one})").alias("a"), J.list_field(F.col("v"), "v").alias("b"),
        F.expr(f"dl_flag({one}, false)").alias("c"), J.bool_field(F.col("v"), "v", F.lit(False)).alias("d"),
    ).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)
    assert [tuple(r) for r in spark.sql("SELECT * FROM dl_page_ranges(250, 100)").collect()] == [(1, 1, 100), (2, 101, 200), (3, 201, 250)]
    assert spark.sql("SELECT * FROM dl_page_ranges(0, 100)").collect() == []


def test_sql_keys_drop_every_blank_without_a_pattern(spark):
    """All blanks of fixed.BLANK go; the keys are looked up character by character, and single blanks of a text are left alone."""
    from deedloom.functions.text import STRIP_CHARS

    sqlfuncs.register(spark)
    df = spark.createDataFrame([("A-1." + STRIP_CHARS + "b æ",), (None,), ("",)], "x string")
    out = df.selectExpr("dl_archive_key(x) a", "dl_match_key(x) m", "dl_parcel_key(x) p", "dl_clean_text('a  b\t c d') c")
    assert [tuple(r) for r in out.collect()] == [("a1.bæ", "a1bæ", "a-1.bæ", "a b c d"), (None, None, None, "a b c d"), ("", "", None, "a b c d")]
    plan = out.select("a", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
