"""From chunks over prompts and stored answers to records with evidence, by hand-worked cases."""

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from deedloom.functions import text as T
from deedloom.operators import answers as A
from deedloom.plans import extract as EX

CHUNK = "case_id string, document_id string, chunk_index int, chunk_id string, page int, text string"
DOCUMENT = "case_id string, document_id string, document_type string, filename string, pos int"


@pytest.fixture(scope="module")
def world(spark):
    """Case c has a register extract and two deeds, case f has a deed alone, the register answer of case x fails."""
    chunks = [
        ("c", "reg", 0, "r0", 1, "Servitut 01.02.1950-1-40 akt 40 F 7 vej"),
        ("c", "deed", 0, "d0", 1, "indledning uden noget"), ("c", "deed", 1, "d1", 1, "tinglyst 01.02.1950-1-40"), ("c", "deed", 2, "d2", 2, "akt 40-F 7 nævnes"),
        ("c", "deed", 3, "d3", 2, "fjern tekst"), ("c", "deed", 4, "d4", 3, "mere fjern tekst"),
        ("c", "mute", 0, "m0", 1, "intet at finde her"),
        ("f", "alone", 0, "a0", 1, "en servitut om færdsel"), ("f", "alone", 1, "a1", 2, "blank side"), ("f", "alone", 2, "a2", 3, "tinglyst deklaration"),
        ("x", "xreg", 0, "x0", 1, "Servitut"), ("x", "xdeed", 0, "x1", 1, "servitut"),
    ]
    docs = [
        ("c", "reg", "tinglysningsattest", "a.pdf", 0), ("c", "deed", "akt", "b.pdf", 1), ("c", "mute", "akt", "c.pdf", 2), ("f", "alone", "akt", "d.pdf", 0),
        ("x", "xreg", "tinglysningsattest", "e.pdf", 0), ("x", "xdeed", "akt", "f.pdf", 1),
    ]
    item = lambda **k: k
    given = {
        "reg": [item(date_reference="01.02.1950-1-40", akt_nr="40 F 7", title="Vejret", confidence=0.4)],
        "deed": [item(date_reference="01.02.1950-1-40", summary="Fra akten", confidence=0.9), item(akt_nr="99 Z 9", title="Ukendt", confidence=0.8)],
        "mute": [item(date_reference="01.02.1950-1-40", summary="skal aldrig ses", confidence=1.0)],
        "alone": [item(date_reference="03.03.1960-5-40", title="Ene"), item(date_reference="03.03.1960-5-40", title="Igen", summary="fyldigere")],
    }
    asked = []

    def ask(prompts):
        asked.append(prompts.select("document_id", "prompt", "max_tokens").collect())
        stored = spark.createDataFrame([(d, json.dumps(v)) for d, v in given.items()], "document_id string, response_text string")
        return A.answer(prompts, prompts.join(stored, "document_id").select("prompt_hash", "response_text"))

    templates = spark.createDataFrame([("akt", "ALM {chunks_text}"), ("tinglysningsattest", "ATTEST {chunks_text}")], "source_type string, template string")
    parcels = spark.createDataFrame([("c", ["1a"])], "case_id string, all_matrikler array<string>")
    result = EX.extract_document_records(
        spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(docs, DOCUMENT), parcels, ask, templates, "{canonical_json}|{all_matrikler_json}|{akt_dok_hint}|{chunks_text}"
    )
    return [df.collect() for df in result], {r.document_id: r for rows in asked for r in rows}


def test_records_of_both_passes(world):
    (records, _, rejected), _ = world
    got = {(r.case_id, r.akt_nr, r.title, r.summary, r.source_document, r.confidence, r.attest_confirmed) for r in records}
    assert got == {
        ("c", "40 F 7", "Vejret", "Fra akten", "deed", 0.9, True), ("c", "99 Z 9", "Ukendt", None, "deed", 0.8, False),
        ("f", None, "Igen", "fyldigere", "alone", 0.5, True),
    }
    assert [r.case_id for r in rejected] == ["x"]


def test_evidence_of_both_origins(world):
    (records, evidence, _), _ = world
    title = {r.servitut_id: r.title for r in records}
    got = sorted((title[e.servitut_id], e.origin, e.pos, e.chunk_id, e.page) for e in evidence)
    # the record's own chunks; an item that no chunk names falls back to the first chosen ones
    assert got == [
        ("Igen", "deed", 0, "a0", 1), ("Igen", "deed", 1, "a2", 3),
        ("Ukendt", "deed", 0, "d0", 1), ("Ukendt", "deed", 1, "d1", 1), ("Ukendt", "deed", 2, "d2", 2),
        ("Vejret", "deed", 0, "d1", 1), ("Vejret", "deed", 1, "d2", 2), ("Vejret", "register", 0, "r0", 1),
    ]


def test_prompts_follow_types_and_selection(world):
    _, asked = world
    assert asked["reg"].prompt.startswith("ATTEST ") and asked["reg"].max_tokens == 16000
    assert asked["alone"].prompt.startswith("ALM ") and "blank side" not in asked["alone"].prompt
    assert "40 F 7" in asked["deed"].prompt and "mere fjern tekst" not in asked["deed"].prompt
    # a deed without a signal is not asked about
    assert "mute" not in asked


def test_template_falls_back(spark, tmp_path):
    (tmp_path / "akt.txt").write_text("ALM")
    (tmp_path / "attest.txt").write_text("ATT\n2")
    (tmp_path / "note.md").write_text("no")
    templates = A.load_templates(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "attest"), (2, "other"), (3, None)], "i int, t string")
    assert sorted((r.i, r.template) for r in A.with_template(df, templates, F.col("t"), "akt").collect()) == [(1, "ATT\n2"), (2, "ALM"), (3, "ALM")]
    assert [r.template for r in A.with_template(df, templates, F.col("t"), "none").orderBy("i").collect()] == ["ATT\n2", None, None]


def test_ids_with_equal_short_forms_stay_apart(spark):
    # two keys whose digests begin with the same eight digits: found by trying numbers
    import hashlib

    seen, pair = {}, None
    for i in range(400_000):
        h = hashlib.sha256(f"c|{i}".encode()).hexdigest()[:8]
        if h in seen:
            pair = (seen[h], i)
            break
        seen[h] = i
    df = spark.createDataFrame([("c", str(i)) for i in pair], "a string, b string").select(T.entity_id("srv-", F.col("a"), F.col("b")).alias("id"))
    rows = df.select("id", T.short_id("id").alias("short")).collect()
    assert len({r.id for r in rows}) == 2 and len({r.short for r in rows}) == 1 and len(rows[0].short) == 12


def test_parts_of_a_prompt_keep_order(spark):
    docs = spark.createDataFrame([("c", "b", "akt", "x", 0), ("c", "a", "akt", "y", 1)], DOCUMENT)
    item = lambda t: json.dumps([{"title": t, "akt_nr": "1"}])
    ans = spark.createDataFrame(
        [("c", "a", 0, item("3")), ("c", "b", 1, item("2")), ("c", "b", 0, item("1")), ("c", "b", 2, None)], "case_id string, document_id string, part int, response_text string"
    )
    rows = EX.items_from_answers(ans, docs).orderBy("ord").collect()
    assert [(r.ord, r.title, r.document_id) for r in rows] == [(1, "1", "b"), (2, "2", "b"), (3, "3", "a")] and len({r.servitut_id for r in rows}) == 3


def test_answer_partial_is_an_ask(spark):
    p = spark.createDataFrame([("h", "p"), ("i", "q")], "prompt_hash string, prompt string")
    stored = spark.createDataFrame([("h", "svar")], "prompt_hash string, response_text string")
    assert {(r.prompt_hash, r.response_text, r.error) for r in partial(A.answer, responder=stored)(p).collect()} == {("h", "svar", None), ("i", None, "no response")}
