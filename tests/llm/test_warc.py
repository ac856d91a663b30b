import hashlib

import pytest

from deedloom.llm import warc

SCHEMA = "page_id long, url string, html string, value string"


def expected(rows):
    """Plain restatement: one result row per page row."""
    firsts, many = {}, {}
    for page_id, _, html, _ in rows:
        p = (html or "").encode()
        many[p] = many.get(p, 0) + 1
        if page_id is not None:
            firsts[p] = min(firsts.get(p, page_id), page_id)
    out = []
    for page_id, _, html, _ in rows:
        p = (html or "").encode()
        first = firsts.get(p)
        again = len(p) >= 100 and many[p] > 1 and first is not None and (page_id is None or page_id > first)
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=repr)


def test_round_trip_with_magic_inside_payloads(spark):
    record = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [
        (1, "http://a/", "x" * 50 + record + "y" * 80, "clash"),
        (2, "http://a/\r\nContent-Length: 7", "WARC/1.1\r\n" * 40, None),
        (3, None, None, None),
        (4, "", "", None),
        (5, "u", "é" * 50, None),
        (6, "u", "é" * 50, None),
        (6, "u", "é" * 50, None),
        (7, "u", "ends\r\n", None),
        (8, "u", "ends\r\n\r\n", None),
        (None, "u", "é" * 50, None),
        (10, "u", "short twin", None),
        (11, "u", "short twin", None),
        (12, "u", record * 30, None),
        (13, "u", "WARC/1.1", None),
    ] + [(100 + i, f"http://h/{i}", f"page {i} " + "lorem " * (i % 90), None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(warc.round_trip(df)) == expected(rows)


@pytest.mark.parametrize("split_bytes", [1500, 40000])
def test_splits_and_false_chains(spark, tmp_path, split_bytes):
    """One file in many small splits; payloads hold whole false records that point at real ones."""
    false = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {}\r\n\r\n"
    rows = [(i, "http://h/", "".join(false.format(j) + "z" * (j % 37) for j in range(i % 13)) + "t" * (i * 7 % 301), None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = warc.write(df, str(tmp_path / "w"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(split_bytes))
        assert got(warc.read(spark, path)) == expected(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_other_splits_in_the_second_scan(spark, tmp_path, monkeypatch):
    """The scan that fetches torn payloads may be cut otherwise than the first one."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"
    rows = [(i, "http://h/", f"page {i} " + (inner + f"{i % 3}") * (i % 4) + "t" * (i * 7 % 301), None) for i in range(300)]
    path = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(2), str(tmp_path / "w"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old, plain, scans = {k: spark.conf.get(k) for k in names}, warc._pieces, []

    def pieces(*args):
        scans.append(1)
        for k in names:
            spark.conf.set(k, "50000" if len(scans) == 1 else "9000")
        return plain(*args)

    monkeypatch.setattr(warc, "_pieces", pieces)
    try:
        assert got(warc.read(spark, path)) == expected(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(scans) == 2


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
