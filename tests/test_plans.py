import datetime
import json
import os

from pyspark.sql import functions as F, types as ST

from deedloom.functions import sqlfuncs
from deedloom.plans import extract as EX, report as R, stats as S
from deedloom.sources import imports as IM, store
from deedloom.streaming import jobs as SJ

RECORD = (
    "case_id string, servitut_id string, date_reference string, registered_at date, title string, summary string, beneficiary string, "
    "disposition_type string, legal_type string, action_note string, byggeri_markering string, applies_to_matrikler array<string>, "
    "evidence array<struct<chunk_id:string,document_id:string,page:int,text_excerpt:string>>"
)


def record(i, ref=None, reg=None, summary=None, action=None, ben=None, refs=(), ev=()):
    return ("c", f"srv-{i}", ref, reg, f"T{i}", summary, ben, None, None, action, None, list(refs), list(ev))


def report(spark, rows, targets=("0001o",), known=(), register=(), day=None):
    cases = spark.createDataFrame([("c", list(targets), list(known))], "case_id string, target_matrikler array<string>, available_matrikler array<string>")
    docs = spark.createDataFrame([("c", d) for d in register], "case_id string, document_id string")
    return R.build_report(spark.createDataFrame(rows, RECORD), cases, docs, day).orderBy("nr").collect()


def test_as_of_drops_later_records(spark):
    d = datetime.date
    rows = [record(1, "20.12.2022-1-1", d(2022, 12, 20)), record(2, "16.01.2024-1-1", d(2024, 1, 16)), record(3)]
    assert [r.servitut_id for r in report(spark, rows, day="2022-12-20")] == ["srv-1", "srv-3"]


def test_sorting_dedup_and_numbering(spark):
    rows = [record(1, "01.01.1985-1-1"), record(2, "01.01.1957-1-1"), record(3, "01.01.1970-1-1"), record(4, "01.01.1957-1-1"), record(5), record(6)]
    got = report(spark, rows)
    assert [(r.nr, r.servitut_id) for r in got] == [(1, "srv-2"), (2, "srv-3"), (3, "srv-1"), (4, "srv-5"), (5, "srv-6")]


def test_fallback_texts_and_scope(spark):
    ev = [("k1", "doc-r", 1, "attest"), ("k2", "doc-a", 2, "aktens ord")]
    got = report(spark, [record(1, ben="Vejle Amt", refs=["1o"], ev=ev), record(2, refs=["38b"]), record(3, summary="S", action="A", ben="Kommunen")],
                 known=["0001o", "38b"], register=["doc-r"])
    a, b, c = sorted(got, key=lambda r: r.servitut_id)
    assert (a.description, a.action, a.raw_text, a.beneficiary_amt_warning) == ("Ukendt indhold", "Kræver opslag i tingbogsakt", "aktens ord", True)
    assert (a.scope, a.scope_detail, a.relevant_for_project) == ("Ja", "Vedr. matr.nr. 0001o", True)
    assert (b.description, b.scope) == ("Akt ikke gennemgået.", "Nej")
    assert (c.description, c.action, c.scope, c.beneficiary_amt_warning) == ("S", "A", "Måske", False)


def test_editor_save(spark):
    rows = spark.createDataFrame(
        [("c", "20", 0, "A", "", "srv-a", True), ("c", "1", 1, "B", "  ", " ", None)],
        "case_id string, nr string, row_position int, title string, raw_text string, servitut_id string, relevant_for_project boolean",
    ).withColumn("beneficiary_amt_warning", F.lit(None).cast("boolean"))
    got = R.save_edited(rows).orderBy("nr").collect()
    assert [(r.nr, r.title, r.raw_text, r.servitut_id, r.manually_edited) for r in got] == [(1, "B", None, "manual-row-1", True), (2, "A", None, "srv-a", True)]


def test_import_from_a_folder(spark, tmp_path):
    old = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp()
    new = datetime.datetime(2024, 6, 1, tzinfo=datetime.timezone.utc).timestamp()
    for name, content, t in [("a.pdf", b"one", new), ("B.PDF", b"two", new), ("c.pdf", b"one", new), ("d.pdf", b"known", new), ("e.pdf", b"five", old), ("f.txt", b"x", new)]:
        p = tmp_path / name
        p.write_bytes(content)
        os.utime(p, (t, t))
    files = IM.list_pdfs(spark, str(tmp_path)).withColumn("case_id", F.lit("c"))
    known = spark.createDataFrame([("c", b"known")], "case_id string, b binary").select("case_id", F.sha2("b", 256).alias("content_hash"))
    audit = IM.import_audit(files, known, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r.name: r.outcome for r in audit.collect()}
    assert got == {"a.pdf": "imported", "B.PDF": "imported", "c.pdf": "skipped_batch", "d.pdf": "skipped_existing", "e.pdf": "skipped_old"}
    docs = EX.ingest_documents(audit)
    assert docs.count() == 2 and docs.select("document_id").collect() == EX.ingest_documents(audit).select("document_id").collect()


def test_stream_of_files_drops_known_contents(spark, tmp_path):
    for name, content in [("a.pdf", b"one"), ("b.PDF", b"one"), ("c.pdf", b"two"), ("d.txt", b"three")]:
        (tmp_path / name).write_bytes(content)
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for f in list(tmp_path.glob("*.*")):
        f.rename(src / f.name)
    got = SJ.new_contents(SJ.file_stream(spark, str(src)), store)
    assert got.select("content_hash").distinct().count() == got.count() == 2
    # a later run meets all stored contents, however old the new file is
    (src / "e.pdf").write_bytes(b"two")
    (src / "f.pdf").write_bytes(b"four")
    os.utime(src / "f.pdf", (0, 0))
    again = SJ.new_contents(SJ.file_stream(spark, str(src)), store)
    assert again.count() == again.select("content_hash").distinct().count() == 3


def test_waiting_jobs_end_after_the_limit(spark):
    t = datetime.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(j, t + datetime.timedelta(seconds=n), "waiting_for_login") for j, n in (("j1", 0), ("j1", 590), ("j2", 400), ("j2", 590))], "job_id string, ts timestamp, status string"
    )
    now = F.lit(t + datetime.timedelta(seconds=650))
    assert {r.job_id: r.status for r in SJ.job_status(SJ.job_states(ev), now).collect()} == {"j1": "failed", "j2": "waiting_for_login"}


def test_job_states(spark):
    t = datetime.datetime(2024, 1, 1)
    s = lambda n: t + datetime.timedelta(seconds=n)
    ev = spark.createDataFrame(
        [("j1", s(0), "pending"), ("j1", s(5), "completed"), ("j1", s(9), "pending"), ("j2", s(0), "pending"), ("j3", s(900), "importing_documents")],
        "job_id string, ts timestamp, status string",
    )
    got = {r.job_id: r.status for r in SJ.job_status(SJ.job_states(ev), F.lit(s(1000)), 300).collect()}
    assert got == {"j1": "completed", "j2": "failed", "j3": "importing_documents"}


def test_changed_documents_only(spark, tmp_path):
    src, base = str(tmp_path / "src"), str(tmp_path / "base")
    schema = "case_id string, document_id string, text string"
    put = lambda *docs: spark.createDataFrame([("c", d, t) for d, t in docs], schema).coalesce(1).write.mode("append").parquet(src)
    sig = lambda df: df.groupBy("case_id", "document_id").agg(F.sha2(F.max("text"), 256).alias("source_signature"))
    work = lambda df: df.select("document_id", F.upper("text").alias("done"))
    run = lambda: sorted((r.batch, r.document_id, r.done) for r in SJ.process_changed(spark.readStream.schema(schema).parquet(src), sig, work, base).collect() if r.batch >= 0)
    put(("d1", "a"), ("d2", "b"))
    first = [(0, "d1", "A"), (0, "d2", "B")]
    assert run() == first
    put(("d1", "a"), ("d2", "x"), ("d3", "c"))
    second = first + [(1, "d2", "X"), (1, "d3", "C")]
    assert run() == second
    # back to an older text is a change too; the newest fingerprint counts
    put(("d2", "b"))
    assert run() == second + [(2, "d2", "B")]
    # running a batch again stores the same rows once
    step, stored = SJ.changed_step(spark, spark.read.schema(schema).parquet(src).schema, sig, work, base)
    step(spark.createDataFrame([("c", "d1", "a"), ("c", "d2", "x"), ("c", "d3", "c")], schema), 1)
    assert sorted((r.batch, r.document_id, r.done) for r in stored().collect()) == second + [(2, "d2", "B")]


def test_entity_files_and_store(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"case_id": "c1", "name": "Sag"}))
    (tmp_path / "b.json").write_text("{broken")
    schema = ST.StructType([ST.StructField("case_id", ST.StringType()), ST.StructField("name", ST.StringType())])
    good, bad = store.read_entities(spark, str(tmp_path), schema)
    assert [r.case_id for r in good.collect()] == ["c1"] and bad.count() == 1
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("c1", 1), ("c2", 2)], "case_id string, v int")
    store.save_partitions(df, path)
    store.save_partitions(spark.createDataFrame([("c1", 9)], "case_id string, v int"), path)
    back = spark.read.parquet(path)
    assert {(r.case_id, r.v) for r in back.collect()} == {("c1", 9), ("c2", 2)}
    assert "PartitionFilters: [isnotnull(case_id" in store.lookup(back, case_id="c1")._jdf.queryExecution().toString()
    links = spark.createDataFrame([("c", 0, "d0"), ("c", 1, "d1")], "case_id string, pos long, document_id string")
    new = spark.createDataFrame([("c", "d1", 1), ("c", "d2", 2), ("c", "d2", 3), ("e", "d9", 1)], "case_id string, document_id string, o int")
    got = {(r.case_id, r.pos, r.document_id) for r in store.append_links(links, new, "o").collect()}
    assert got == {("c", 0, "d0"), ("c", 1, "d1"), ("c", 2, "d2"), ("e", 0, "d9")}


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    r = spark.sql("SELECT dl_clean_text(' a\r\nb ') a, dl_parcel_key('000 5AY') b, dl_chunk_id('doc-abc', 1, 0) c, dl_has_amt('Vejle Amt') d").first()
    assert (r.a, r.b, r.c, r.d) == ("a\nb", "5ay", "0bb116476921", True)


def test_register_answers_merge_and_gate(spark):
    chunks = spark.createDataFrame(
        [("c", "d", 0, "k0", 1, "side et"), ("c", "d", 1, "k1", 2, "side to"), ("x", "e", 0, "k2", 1, "andet")],
        "case_id string, document_id string, chunk_index int, chunk_id string, page int, text string",
    )
    from deedloom.operators import segments as G

    seg = G.build_segments(chunks, max_pages=1, overlap=0)
    docs = spark.createDataFrame([("c", "d", 0), ("x", "e", 0)], "case_id string, document_id string, pos int")
    item = lambda **k: json.dumps([k])
    ans = spark.createDataFrame(
        [("c", "d", "d-segment-0000", item(date_reference="01.02.1950-1-40", title="Vej"), None),
         ("c", "d", "d-segment-0001", item(date_reference="01.02.1950-1-40", akt_nr="40 F 1", title="Vejret"), None),
         ("x", "e", "e-segment-0000", None, "fejl")],
        "case_id string, document_id string, segment_id string, response_text string, error string",
    )
    merged, evidence, rejected = EX.canonical_from_answers(seg, chunks, ans, docs)
    got = merged.collect()
    assert [(r.case_id, r.ord, r.akt_nr, r.title, r.scope_source) for r in got] == [("c", 0, "40 F 1", "Vejret", "attest")]
    assert [r.case_id for r in rejected.collect()] == ["x"]
    assert sorted((r.servitut_id, r.pos, r.chunk_id, r.page) for r in evidence.collect()) == [(got[0].servitut_id, 0, "k0", 1), (got[0].servitut_id, 1, "k1", 2)]


def test_statistics(spark):
    pages = spark.createDataFrame([("c", 0.9, "abcd"), ("c", 0.2, "ab"), ("c", 0.0, "")], "case_id string, confidence double, text string")
    chunks = spark.createDataFrame([("c", "en servitut"), ("c", "intet")], "case_id string, text string")
    r = S.reading_evaluation(pages, chunks).first()
    assert (r.mean_confidence, r.total_chars, r.chunks, r.keyword_chunks) == (0.9, 6, 2, 1)


def test_intermediates_leave_nothing_behind(spark, tmp_path):
    from deedloom.session import intermediates, materialize

    with intermediates(spark) as folder:
        assert materialize(spark.range(10)).count() == 10 and len(os.listdir(folder)) == 1
    assert not os.path.exists(folder)


def test_report_prompts_hold_the_cases_and_let_their_parts_pass(spark):
    from deedloom.operators import answers as A

    inputs = spark.range(600).selectExpr(
        "concat('c', cast(id % 2 as string)) as case_id", "concat('s-', lpad(id, 4, '0')) as servitut_id", "'01.02.1970' as date_reference", "repeat('t', 50) as title"
    )
    cases = spark.createDataFrame([("c0", ["1a"], []), ("c1", [], ["2b"]), ("c2", [], [])], "case_id string, target_matrikler array<string>, available_matrikler array<string>")
    p = A.report_prompts(inputs, cases, "{as_of_date} {target_matrikler_json} {servitutter_json}", "1999-01-01", limit=20_000)
    got = {}
    for r in p.collect():
        got.setdefault(r.case_id, []).append((r.part, r.prompt.count('"servitut_id"')))
    assert {c: sum(n for _, n in v) for c, v in got.items()} == {"c0": 300, "c1": 300, "c2": 0}
    assert len(got["c0"]) > 2 and sorted(k for k, _ in got["c0"]) == list(range(len(got["c0"]))) and got["c2"] == [(0, 0)]
    # no outer join that would keep all long parts of a case in memory at once
    assert "LeftOuter" not in p.select("case_id", "prompt")._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_report_answers_are_parsed_once(spark):
    from deedloom.operators import answers as A

    given = spark.createDataFrame(
        [("c1", '```json\n{"notes": "n", "entries": [{"servitut_id": "s", "scope": "Ja"}]}\n```'), ("c2", "intet svar")], "case_id string, response_text string"
    )
    entries, notes = A.report_payload(given)
    assert [(r.case_id, r.servitut_id, r.relevant_for_project) for r in entries.collect()] == [("c1", "s", True)]
    assert [tuple(r) for r in notes.collect()] == [("c1", "n")]
    for df in (entries, notes):
        assert "response_text" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_scopes_are_counted_without_evidence_and_numbers(spark):
    rows = [record(1, "01.01.1985-1-1", refs=["1o"]), record(2, "01.01.1985-1-1"), record(3, refs=["9z"]), record(4, reg=datetime.date(2030, 1, 1))]
    cases = spark.createDataFrame([("c", ["0001o"], ["1o", "9z"])], "case_id string, target_matrikler array<string>, available_matrikler array<string>")
    df, docs = spark.createDataFrame(rows, RECORD), spark.createDataFrame([], "case_id string, document_id string")
    counted = R.scope_counts(R.scope_entries(df, cases, "2024-01-01"))
    assert counted.collect() == R.scope_counts(R.build_report(df, cases, docs, "2024-01-01")).collect() and counted.first().entries == 2
    # only the choice of the first record of a date deals records out, once, and no evidence travels
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "posexplode" not in plan


def test_stream_reuse_writes_its_changed_pages_once(spark, monkeypatch):
    from checks import queries as Q

    def refused(df):
        raise AssertionError("pages are written a second time")

    monkeypatch.setattr(Q, "materialize", refused)
    assert Q.QUERIES["stream_reuse"](spark, "/root/testdata/sf0.001").count() > 0


def test_report_numbers_do_not_need_few_groups(spark):
    """Positions come from ranges of rows: what is added up is a row per case and range, and each entry is made once."""
    from deedloom.operators.positions import numbered

    rows = [("a", i * 7 % 100, i) for i in range(100)] + [(None, 5, 1), (None, 4, 2), ("b", 1, 1)]
    got = numbered(spark.createDataFrame(rows, "case_id string, k int, i int"), ["case_id"], ["k", "i"], "nr").collect()
    assert sorted((r.case_id or "", r.nr, r.k) for r in got) == [("", 1, 4), ("", 2, 5), *[("a", k + 1, k) for k in range(100)], ("b", 1, 1)]
    ev = [("k1", "doc-r", 1, "x"), ("k2", "doc-r", 2, "y"), ("k3", "doc-z", 3, "z" * 600)]
    df = spark.createDataFrame([record(1, ev=ev), record(2, ev=ev[:2]), record(3, ev=ev[2:]), record(4)], RECORD)
    cases = spark.createDataFrame([("c", ["1a"], [])], "case_id string, target_matrikler array<string>, available_matrikler array<string>")
    docs = spark.createDataFrame([("c", "doc-r")], "case_id string, document_id string")
    entries = R.build_report(df, cases, docs)
    assert [r.raw_text for r in entries.orderBy("nr").collect()] == ["z" * 500, None, "z" * 500, None]
    # neither numbers nor lines read the records again, and no window runs over a whole case
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LogicalRDD" not in plan
    lines = R.markdown_table(entries)
    assert sorted(r.line_no for r in lines.collect()) == [1, 2, 3, 4, 5, 6]
    reports = cases.selectExpr("case_id", "'r' as report_id", "target_matrikler", "available_matrikler", "cast(null as date) as as_of_date", "'' as notes")
    assert sorted(r.line_no for r in R.markdown_document(reports, entries).collect()) == list(range(1, 14))


def test_edited_rows_are_numbered_without_blocks(spark):
    rows = spark.range(300).selectExpr("'c' as case_id", "cast(9000 - id as string) as nr", "id as row_position", "'s' as servitut_id", "true as relevant_for_project", "false as beneficiary_amt_warning", "cast(id as string) as title")
    out = R.save_edited(rows)
    assert [r.title for r in out.orderBy("nr").collect()] == [str(i) for i in range(299, -1, -1)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_entity_files_are_put_in_place_by_their_tasks(spark, tmp_path):
    store.save_entities(spark.range(0, 7, 1, 3).select(F.to_json(F.struct("id")).alias("value")), str(tmp_path / "e"))
    assert len(list((tmp_path / "e").glob("part-*.txt"))) == 7 and (tmp_path / "e" / "_SUCCESS").exists() and not (tmp_path / "e" / "_temporary").exists()
    good, bad = store.read_entities(spark, str(tmp_path / "e"), ST.StructType.fromDDL("id bigint"))
    assert sorted(r.id for r in good.collect()) == list(range(7)) and bad.isEmpty()
