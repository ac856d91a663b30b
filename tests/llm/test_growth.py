"""What is broadcast and held does not grow with the rows behind a wrong estimate."""

from pyspark.sql import functions as F

from deedloom.llm import simhash
from deedloom.session import materialize


def test_bands_are_not_broadcast(spark):
    """After the explode the planner sees a small part of the codes' file, though it is 32 rows a code."""
    codes = materialize(spark.range(3000).select(F.col("id").alias("v"), F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("code")))
    met = simhash.bands(codes)
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert 2000 < met.select("v").distinct().count() < 2600


def test_tokens_of_texts_are_those_of_their_bytes():
    """Each distinct word is hashed and looked up once in a slice; words are those of bytes.split()."""
    import pyarrow as pa

    from deedloom.llm import lm_score
    from deedloom.llm.common import lower_blank_words

    texts = ["Æble b B\x0bb\x1cc", None, "", "  x y z x ", "\t\r\n", "b"] + [chr(i) + "A" for i in range(300)]
    found = lm_score.Tokens(pa.array(["skipped", *texts]).slice(1))
    words = [lower_blank_words(t) for t in texts]
    assert [found.words[c] for c in found.codes] == [w for x in words for w in x] and found.lengths.tolist() == [len(x) for x in words]
    assert len(set(found.words)) == len(found.words)
    known, _, rare = lm_score.looked_up(found, {b"b": 1.0}, 3)
    assert known.tolist() == [1 + x.count(b"b") for x in words]
    assert [sorted((r["word"], r["n"]) for r in x) for x in rare.to_pylist()] == [sorted((w, x.count(w)) for w in set(x) - {b"b"}) for x in words]
