import random

import corpus_pipeline
from deedloom.llm import decontaminate, quality_classifier, quality_rules, simhash, source_mix

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """The run equals the stages one by one, each checked against its own operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns
        if name == "quality classifier":
            want = quality_classifier.judge(now, labels).where("kept")
        elif name == "quality rules":
            want = quality_rules.judge(now).where("kept")
        elif name == "simhash near-dedup":
            want = simhash.similar(now).select("component_id").distinct().withColumnRenamed("component_id", "doc_id")
        else:
            want = decontaminate.report(decontaminate.contamination(now, bench)).where("not contaminated")
        assert ids(out) == ids(want) and 0 < out.count() <= now.count()
        now = out
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(source_mix.mix(now))


def test_stages_with_nulls_repeats_and_further_columns(spark, tmp_path):
    """No stage crashes, and every stage keeps the columns, whatever they are called."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(300)]
    prose = lambda: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(10)) for _ in range(20))
    rows = [(i, prose(), None if i % 4 == 0 else "s1", 1, "x", 2.0, "y") for i in range(20)]
    rows += [(None, None, None, 1, "x", 2.0, "y"), (None, rows[3][1], "s1", 1, "x", 2.0, "y"), rows[5], rows[5], (50, "", "s2", 1, "x", 2.0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, fp string, key double, words string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    kept = now.collect()
    assert sorted(r.doc_id for r in kept) == list(range(20))
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == 20


def test_empty_documents(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
