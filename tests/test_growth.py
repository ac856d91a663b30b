"""Work that grew with pairs: what is looked for in a case is read beside its texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from deedloom.operators import answers as A, beside as B, signals as S

CHUNKS = "case_id string, document_id string, chunk_index int, chunk_id string, page int, text string"


@pytest.mark.parametrize("group, piece", [(8192, 200_000), (2, 200_000), (3, 2)])
def test_signals_are_read_beside_the_chunks(spark, monkeypatch, group, piece):
    """Any cut of a case gives the same matches and scores; a repeated chunk counts once, a case without a name has none."""
    monkeypatch.setattr(B, "GROUP", group)
    monkeypatch.setattr(B, "PIECE", piece)
    texts = ["Vejretten, akt 12-F 7", "ab uden tal", "strandvejen 1a og vejret", "", None, "12 f.7 strand"]
    chunks = spark.createDataFrame([(c, f"d{i % 3}", i, "k", 1, t) for c in ("a", "b", None) for i, t in enumerate(texts)] + [("a", "d0", 0, "k", 1, "vejret")], CHUNKS)
    values = [("akt_nr", "12f7"), ("matrikel", "1a"), ("title_word", "vejret"), ("title_word", "strand"), ("matrikel", "uden")]
    sig = spark.createDataFrame([(c, t, v, f"{t}:{v}") for c in ("a", None) for t, v in values], "case_id string, signal_type string, normalized_value string, signal_key string")
    rows = S.match_signals(chunks, sig)
    assert " Join " not in rows._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftOuter, (case_id", "")
    want = {(0, "akt_nr:12f7"), (0, "title_word:vejret"), (1, "matrikel:uden"), (2, "matrikel:1a"), (2, "title_word:strand"), (2, "title_word:vejret"), (5, "akt_nr:12f7"),
            (5, "title_word:strand")}
    assert sorted((r.case_id, r.chunk_index, r.signal_key) for r in rows.collect()) == sorted(("a", *x) for x in want)
    scored = S.score_chunks(chunks, sig).collect()
    assert len(scored) == 19 and {(r.chunk_index, x) for r in scored for x in r.reasons} == want
    catalog = sig.select("case_id", "signal_key", F.lit("L").alias("label"), F.lit(2).alias("weight"), F.array(F.lit("X")).alias("display_values"))
    records = sig.select("case_id", "signal_key", F.lit(1).alias("ord"), F.lit(None).cast("string").alias("date_reference"), F.lit("T").alias("title"))
    told = S.chunk_provenance(chunks, sig.join(records, ["case_id", "signal_key"]), catalog)
    given = S.signal_provenance(rows, records, catalog)
    assert sorted(told.collect()) == sorted(given.collect()) and told.count() == 4


def test_prompts_of_deeds_are_hashed_from_the_head_of_their_case(spark, monkeypatch):
    """Marks inside values, a list in several parts, a case without list; hashes and lengths are those of whole prompts."""
    monkeypatch.setattr(A, "DEEDS", 2)
    template = "R:\n{canonical_json}\nP: {all_matrikler_json}\nK: {akt_dok_hint}\n\n{chunks_text}\n{akt_dok_hint}"
    chunks = spark.createDataFrame([("a", f"d{i}", 0, "k", 1, f"tekst {i} æ {{akt_dok_hint}}") for i in range(5)] + [("b", "d9", 0, "k", 1, "x")], CHUNKS)
    long = "t" * 900_000
    canon = spark.createDataFrame([("a", i, None, "{chunks_", f"{long}{i}") for i in range(4)], "case_id string, ord long, date_reference string, akt_nr string, title string")
    docs = spark.createDataFrame([("a", "d0", "text} {chunks_text}")], "case_id string, document_id string, filename string")
    parcels = spark.createDataFrame([("a", ["1a", None])], "case_id string, all_matrikler array<string>")
    lists = {(r.case_id, r.part): r.canonical_json for r in A.canonical_json(canon).collect()}
    blocks = {(r.case_id, r.document_id): r.chunks_text for r in A.chunks_text(chunks).collect()}
    want = set()
    for (case, doc), block in blocks.items():
        for part, listed in [(p, x) for (c, p), x in lists.items() if c == case] or [(0, "[]")]:
            text = template.replace("{canonical_json}", listed).replace("{all_matrikler_json}", '["1a", null]' if case == "a" else "[]")
            text = text.replace("{akt_dok_hint}", "text} {chunks_text}" if doc == "d0" else doc).replace("{chunks_text}", block)
            want.add((case, doc, part, len(text), hashlib.sha256(text.encode()).hexdigest()))
    assert len(want) > 6
    light = A.deed_prompts(chunks, canon, docs, parcels, template, text=False)
    assert "prompt" not in light.columns
    assert {(r.case_id, r.document_id, r.part, r.chars, r.prompt_hash) for r in light.collect()} == want
    whole = A.deed_prompts(chunks, canon, docs, parcels, template)
    got = whole.select("case_id", "document_id", "part", F.length("prompt").alias("n"), F.sha2("prompt", 256).alias("h"), "prompt_hash").collect()
    assert {tuple(r)[:5] for r in got} == want and all(r.h == r.prompt_hash for r in got)


def test_records_of_a_case_are_read_beside_its_chunks(spark, monkeypatch):
    """Any cut of a case gives the same best chunks, ties by document and index, and no list of a word's chunks is written."""
    from deedloom.operators import retrieve as RT

    chunks = spark.createDataFrame([("c", f"d{i % 5}", i, f"ord{i % 7} xvej grund{i % 3}" if i % 4 else None) for i in range(60)] + [("c", "d1", 1, "ord9")],
                                   "case_id string, document_id string, chunk_index int, text string")
    records = spark.createDataFrame([("c", f"r{i}", "x", f"Ord{i} vej grund{i % 4} und", None, None) for i in range(9)],
                                    "case_id string, servitut_id string, source_document string, title string, summary string, beneficiary string")
    texts = {}
    for c in chunks.collect():
        texts[c.document_id, c.chunk_index] = texts.get((c.document_id, c.chunk_index), "") + " " + (c.text or "")
    want = set()
    for i in range(9):
        words = {f"ord{i}", "vej", f"grund{i % 4}", "und"}
        rows = sorted((-sum(w in t for w in words), *at) for at, t in texts.items())
        want |= {(f"r{i}", d, at, round(-m / 4, 6), n + 1) for n, (m, d, at) in enumerate(rows[:5]) if m}
    sizes, real = [], RT.materialize

    def watched(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(RT, "materialize", watched)
    for group, piece in ((8192, 200_000), (4, 200_000), (7, 2)):
        monkeypatch.setattr(B, "GROUP", group)
        monkeypatch.setattr(B, "PIECE", piece)
        got = RT.keyword_top_k(records, chunks).select("servitut_id", "document_id", "chunk_index", "score", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert sizes[0] == 0


def test_answers_are_parsed_once_and_completed_from_light_records(spark):
    """The inputs of answers hold no evidence and nothing else of a record; a candidate is parsed once, an answer that is no object has no entries."""
    from deedloom.functions import jsonx as J
    from deedloom.plans import report as R

    ev = "array<struct<document_id:string,text_excerpt:string>>"
    rows = [("c", f"s{i}", d, None, f"T{i}", e, "x" * 50) for i, (d, e) in enumerate([("1.1.1990", [("reg", "a"), ("akt", "b")]), ("1.1.1990", [("akt", "c")]), (None, []), ("2.2.1990", [("reg", "d")])])]
    records = spark.createDataFrame(rows, f"case_id string, servitut_id string, date_reference string, registered_at date, title string, evidence {ev}, summary string")
    known = spark.createDataFrame([("c", "reg")], "case_id string, document_id string")
    inputs, side = R.answer_inputs(records, known, "1999-01-01")
    assert inputs.columns == ["case_id", "servitut_id", "date_reference", "title"] and "summary" not in side.columns
    assert {(r.servitut_id, r.title, r.raw_text) for r in side.collect()} == {("s0", "T0", "b"), ("s2", "T2", None), ("s3", "T3", None)}
    texts = ['```json\n{"entries": [{"servitut_id": "s0"}]}\n```', 'Svar {"entries": [{"servitut_id": "u", "date_reference": "1.1.1990"}]} slut', "[]", '{"entries": 3}', None, '{"a": 1} {"b": 2}', '[{"entries": []}]']
    answers = spark.createDataFrame([("c", t) for t in texts], "case_id string, response_text string")
    assert [r.n for r in answers.select(J.answer_object("response_text").isNotNull().alias("n")).collect()] == [True, True, False, True, False, False, True]
    entries, _ = A.report_payload(answers, written=False)
    done = R.answered_entries(entries, side, known)
    assert sorted((r.servitut_id, r.raw_text) for r in done.collect()) == [("s0", "b"), ("u", "b")]
    parsed = J.answer_items(F.col("response_text"))._jc.toString()
    assert parsed.count("try_parse_json") <= 1


def test_entity_files_are_read_many_a_task(spark, tmp_path, monkeypatch):
    from pyspark.sql.types import StructType

    from deedloom.sources import store

    for i in range(200):
        (tmp_path / f"{i}.json").write_text('{"id": %d}' % i if i % 9 else "{broken")
    tasks, real, name = [], store.materialize, "spark.sql.files.openCostInBytes"
    monkeypatch.setattr(store, "materialize", lambda df: tasks.append(df.rdd.getNumPartitions()) or real(df))
    before = spark.conf.get(name)
    good, bad = store.read_entities(spark, str(tmp_path), StructType.fromDDL("id bigint"))
    assert (good.count(), bad.count()) == (177, 23) and tasks[0] <= 5 and spark.conf.get(name) == before
