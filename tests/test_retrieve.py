"""Best chunks per record against scoring every chunk."""

import random
import re

import pytest

from deedloom.operators import retrieve as RT


def scored(records, chunks, k=5):
    """Every chunk of the pool is scored; ties by document and index."""
    out = set()
    for case, rid, doc, title, summary, beneficiary in records:
        words = list(dict.fromkeys(w for w in re.findall(r"\w{3,}", " ".join(x for x in (title, summary, beneficiary) if x).lower())))
        pool = [c for c in chunks if c[0] == case and c[1] == doc] or [c for c in chunks if c[0] == case]
        rows = sorted((-sum(w in c[3].lower() for w in words), c[1], c[2]) for c in pool) if words else []
        out |= {(case, rid, d, i, round(-m / len(words), 6), r + 1) for r, (m, d, i) in enumerate(rows[:k]) if m}
    return out


RECORD = "case_id string, servitut_id string, source_document string, title string, summary string, beneficiary string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_chunks_equal_scoring_all(spark, seed):
    rng = random.Random(seed)
    # a few words are everywhere, most are rare; some words lie inside others
    words = ["vej", "vejle", "grund", "und"] * 20 + [f"ord{i}" for i in range(60)] + ["ord1x", "xord2", "Ål"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(f"c{i % 2}", f"d{i % 7}", i, text(rng.randint(0, 25))) for i in range(120)]
    records = [(f"c{i % 3}", f"r{i}", rng.choice(["d1", "d2", "none"]), text(rng.randint(0, 6)), rng.choice([None, text(8), "vej und"]), rng.choice([None, "", "Vejle Amt"])) for i in range(80)]
    r = spark.createDataFrame(records, RECORD)
    c = spark.createDataFrame(chunks, "case_id string, document_id string, chunk_index int, text string")
    got = {tuple(x) for x in RT.keyword_top_k(r, c).select("case_id", "servitut_id", "document_id", "chunk_index", "score", "rank").collect()}
    assert got == scored(records, chunks) and len(got) > 100


def test_common_words_are_not_looked_up(spark, monkeypatch):
    """Records with two rare words settle on their lists; the long list of the common word is never joined."""
    chunks = [("c", "d", i, f"fælles rare{i // 6} sjælden{i // 6}") for i in range(600)]
    records = [("c", f"r{i}", "x", f"fælles rare{i} sjælden{i}", None, None) for i in range(20)]
    sizes, real = [], RT.materialize

    def watched(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(RT, "materialize", watched)
    r = spark.createDataFrame(records, RECORD)
    c = spark.createDataFrame(chunks, "case_id string, document_id string, chunk_index int, text string")
    got = {tuple(x) for x in RT.keyword_top_k(r, c).select("case_id", "servitut_id", "document_id", "chunk_index", "score", "rank").collect()}
    assert got == scored(records, chunks)
    # postings, ordered words, first candidates (k a record)
    assert sizes[1:] == [20, 100]


def test_words_of_a_document_are_not_dealt_out(spark):
    """Records with a document of their own meet its text; only records of a whole case need pieces of words."""
    chunks = [("c", f"d{i}", 0, f"vej grund{i}") for i in range(4)]
    records = [("c", f"r{i}", f"d{i}", f"Grund{i} rund{i}", None, None) for i in range(4)]
    plans, real = [], RT.materialize

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(RT, "materialize", watched)
        r = spark.createDataFrame(records, RECORD)
        c = spark.createDataFrame(chunks, "case_id string, document_id string, chunk_index int, text string")
        got = {tuple(x) for x in RT.keyword_top_k(r, c).select("case_id", "servitut_id", "document_id", "chunk_index", "score", "rank").collect()}
    assert got == scored(records, chunks)
    # pieces are made of a word alone, without case or pool
    assert "Contains(_t" in plans[0] and all("pool" not in x for x in plans[0].splitlines() if "Generate explode(array_distinct(regexp_extract_all(token" in x)
