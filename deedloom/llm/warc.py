"""WARC archives: writing pages as records, and reading archives back in splits by boundary-chain verification.

Writing. One record per page, through Spark's text writer with the record trailer as separator, so files follow
its commit protocol. Pages of equal payload of at least `REVISIT_BYTES` keep one response; the others become revisit
records that refer to it.

Reading. Splits of a file are cut at the magic line, wherever it stands, also inside payloads. Every piece is a
candidate record with the offset of its successor (header and content length). Inside a split, consecutive
candidates that point at each other form runs; pointer jumping over the runs of a file, from offset 0, doubles the
proven part in each round. Only records that are reached count; pieces between them are payload and are joined to
their record again. Rounds grow with the logarithm of the number of splits of a file.

Offsets, not payloads, are shuffled while reading; a payload moves only if it contains the magic. Its pieces come from
a second scan and are known there by file and digest, as splits and row numbers may differ from one scan to the next.

Edge cases: a null html is an empty payload; a null url leaves the target header out; control characters in a url
are written as blanks; a null page_id is an empty id, never the first of its payload; repeated rows of the smallest
page_id of a payload are all responses; a file that does not begin with a record gives none; a record whose end
lies beyond the file ends the chain and is left out; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from deedloom.llm.common import columns, small_enough
from deedloom.session import materialize, shared_folder

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its size and digest."""
    given = columns(pages, ("page_id", "long"), ("url", "string"), ("html", "string"))
    payload = F.coalesce("html", F.lit(""))
    return given.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("bytes"), F.sha2(payload, 256).alias("digest"))


def records(pages: DataFrame) -> DataFrame:
    """The text of one WARC record per page, without its trailer."""
    paid = with_payload(pages)
    shared = (
        paid.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    # a payload is sent to its digest only if the repeated digests are too many for a broadcast
    both = paid.join(small_enough(materialize(shared), 128), "digest", "left").withColumn(
        "again", F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n")
    )
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "payload"))
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")
    header = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)), F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), line("Content-Type", F.lit("application/http;msgtype=response")),
    )
    sized = both.select(header.alias("header"), block.alias("block"))
    return sized.select(F.concat("header", line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block").alias("value"))


def write(pages: DataFrame, path: str | None = None) -> str:
    """Writes the archive files and returns their folder."""
    path = path or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records(pages).write.option("lineSep", END).text(path)
    return path


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text between magics: file, split, order in the scan, value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("m"), "value",
    )


def parsed(df: DataFrame) -> DataFrame:
    """Header fields and payload of `value`, a record without its magic; `full` is whether all its bytes are there."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    cut = df.withColumn("head", head).withColumns({
        "head_bytes": F.octet_length("head").cast("long"), "declared": field("Content-Length").try_cast("long"), "record_type": field("WARC-Type"),
        "page_id": page(field("WARC-Record-ID")), "refers_to": page(field("WARC-Refers-To")),
        "stated": F.regexp_extract(field("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1),
    })
    cut = cut.withColumn("length", F.col("head_bytes") + 4 + F.col("declared") + 4)
    cut = cut.withColumn("full", F.coalesce(F.octet_length("value") >= F.col("length"), F.lit(False)))
    binary = F.col("value").cast("binary")
    block = F.when(F.col("full"), F.substring(binary, (F.col("head_bytes") + 5).cast("int"), F.col("declared").cast("int")))
    cut = cut.withColumn("block", block)
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1))
    payload = F.substring(F.col("block"), (http + 5).cast("int"), F.lit(2**31 - 1))
    return cut.withColumn("payload", payload).drop("head", "block")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per piece with its offset and, if it parses, its successor; payloads only as size and digest."""
    looked = parsed(_pieces(spark, path)).select(
        "file", "split", "m", F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("piece"), "length", "full", "record_type", "page_id", "refers_to", "stated",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"),
    )
    seen = materialize(looked)
    step = len(MAGIC)
    splits = seen.groupBy("file", "split").agg(F.sum(F.col("bytes") + step).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("m")
    local = seen.withColumn("at", F.coalesce(F.sum(F.col("bytes") + step).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # `off` is where the magic of a piece stands; the piece before the first magic has offset -10 and is no candidate
    placed = local.join(base, ["file", "split"]).withColumn("off", F.col("base") + F.col("at") - step).drop("base", "at", "bytes")
    placed = placed.withColumn("next", F.when(F.col("off") >= 0, F.col("off") + step + F.col("length")))
    fresh = F.coalesce(F.lag("next").over(inside) != F.col("off"), F.lit(True))
    return placed.withColumn("run", F.max(F.when(fresh, F.col("off"))).over(inside))


def reachable(pieces: DataFrame) -> DataFrame:
    """Runs (file, run, entry) on the chain from the start of each file, by pointer jumping."""
    runs = pieces.groupBy("file", "run").agg(F.max_by("next", "off").alias("entry"))
    hop = pieces.select("file", F.col("off").alias("entry"), F.col("run").alias("to"))
    jump = materialize(runs.join(hop, ["file", "entry"]).select("file", "run", "to", "entry"))
    done = materialize(pieces.where("off = 0").select("file", "run", F.lit(0).cast("long").alias("entry")))
    while not jump.isEmpty():
        further = done.drop("entry").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        done = materialize(done.unionByName(further))
        second = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = materialize(jump.join(second, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")))
    return done


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, payload_bytes, payload_digest, refers_to, stated, file, off.

    For revisits size and digest are those of the response that they refer to, found by id and stated digest.
    """
    pieces = materialize(candidates(spark, path))
    proven = pieces.join(reachable(pieces), ["file", "run"], "left").withColumn(
        "record", F.col("entry").isNotNull() & (F.col("off") >= F.col("entry")) & F.col("length").isNotNull()
    )
    owner = F.last(F.when(F.col("record"), F.col("off")), True).over(Window.partitionBy("file").orderBy("off"))
    owned = materialize(proven.withColumn("owner", owner).drop("entry", "run", "split"))
    whole = owned.where("record and full")

    # records that hold the magic in their payload: fetch their pieces by content and join them
    torn = owned.where("record and not full").select("file", "owner")
    needed = materialize(owned.join(torn, ["file", "owner"], "left_semi").select("file", "owner", "piece", "off"))
    wanted = small_enough(materialize(needed.select("file", "piece").distinct()), 512)
    scanned = _pieces(spark, path).select("file", F.sha2("value", 256).alias("piece"), "value").join(wanted, ["file", "piece"], "left_semi")
    # equal pieces of a file are one
    values = scanned.groupBy("file", "piece").agg(F.any_value("value").alias("value"))
    fetched = needed.join(values, ["file", "piece"])
    sewn = fetched.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts")).select(
        "file", F.col("owner").alias("off"), F.array_join("parts.value", MAGIC).alias("value")
    )
    mended = parsed(sewn).where("full").select(
        "file", "off", "record_type", "page_id", "refers_to", "stated", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest")
    )
    every = materialize(whole.select(*mended.columns).unionByName(mended))
    responses = every.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated")).agg(
        F.max("payload_bytes").alias("original_bytes")
    )
    revisits = every.where("record_type = 'revisit'").join(responses, ["refers_to", "stated"], "left").select(
        "page_id", "record_type", F.col("original_bytes").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "refers_to", "stated", "file", "off"
    )
    plain = every.where("record_type = 'response'").select("page_id", "record_type", "payload_bytes", F.col("digest").alias("payload_digest"), "refers_to", "stated", "file", "off")
    return plain.unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives and reads the archives."""
    return read(pages.sparkSession, write(pages))
