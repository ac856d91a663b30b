"""Importance resampling against a plain restatement, and wide SimHash against exact Jaccard."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from deedloom.llm import quality_classifier as qc, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key double, fp string, row int, id int"


def grams(text):
    """Buckets of words and pairs by plain integer arithmetic."""
    mix = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]
    h = [zlib.crc32(w) for w in (text or "").encode().split()]
    m = (1 << 64) - 1
    one = [(x * mix[0] & m) >> 48 for x in h]
    two = [(((x * mix[1] & m) ^ (y * mix[0] & m)) * mix[2] & m) >> 48 for x, y in zip(h, h[1:])]
    return one + two


def expected(rows, labels, seed, temperature):
    """(doc_id, key) of every row and the least key kept."""
    votes = {}
    for i, q in labels:
        if i is not None:
            votes.setdefault(i, []).append(q)
    good = np.array(sorted(i for i, qs in votes.items() if min(qs) == 1), np.int64)
    held = set(good[qc.held(good)].tolist())
    target_ids = set(good.tolist()) - held
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in target_ids:
            target.update(grams(t))
    scale = target.total() / raw.total()
    weight = lambda b: math.log((target[b] + qc.PRIOR) / (raw[b] * scale + qc.PRIOR))
    keys = []
    for i, t in rows:
        g = grams(t)
        noise = float(qc.gumbel(np.array([-1 if i is None else i], np.int64), seed)[0])
        keys.append((i, sum(map(weight, g)) / (len(g) + qc.SMOOTH) + temperature * noise if g else -math.inf))
    sample = np.array([k for i, k in keys if i in held and k > -math.inf])
    return keys, float(np.quantile(sample, qc.LOSS))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    good = lambda n: " ".join(f"g{int(rng.random() ** 2 * 60)}" for _ in range(n))
    bad = lambda n: " ".join(rng.choice("bg") + str(int(rng.random() * 60)) for _ in range(n))
    rows = [(i, (good if i % 3 else bad)(rng.randint(5, 200))) for i in range(240)]
    rows += [(None, good(30)), (None, None), (300, ""), (301, " \n"), (302, None), (5, rows[5][1]), (303, good(20000))]
    labels = [(i, int(i % 3 > 0), 0) for i in range(160)] + [(7, 0, 0), (None, 1, 0)]
    return rows, labels


@pytest.mark.parametrize("seed, temperature", [(7, 0.01), (99, 0.1)])
def test_keys_and_sample_are_restated(spark, corpus, seed, temperature):
    rows, labels = corpus
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = qc.judge(docs, lab, seed, temperature).collect()
    keys, least = expected(rows, [(i, q) for i, q, _ in labels], seed, temperature)
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    for (i, k), (j, w) in zip(sorted(((r.doc_id, r.key) for r in got), key=key), sorted(keys, key=key)):
        assert i == j and (k == w or math.isclose(k, w, abs_tol=1e-9))
    assert sum(r.kept for r in got) == sum(k >= least - 1e-12 for _, k in keys)
    # a text without words is never kept
    assert not any(r.kept for r in got if r.n_words == 0)


def test_other_seeds_draw_other_samples(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    drawn = [{(r.doc_id, r.n_words) for r in qc.judge(docs, lab, s, 0.1).where("kept").collect()} for s in (1, 2)]
    assert len(drawn[0] ^ drawn[1]) > 5 and len(drawn[0] & drawn[1]) > 100


def jaccard(a, b):
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    x, y = cut((a or "").lower().split()), cut((b or "").lower().split())
    return len(x & y) / len(x | y)


def test_similar_documents_meet_and_others_stay(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(base))
        for _ in range(2):
            w = list(base)
            for _ in range(max(1, len(w) // 80)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w + [word() for _ in range(rng.randint(0, len(w) // 20))]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[0].upper()), (901, None), (902, ""), (None, texts[3]), (5, texts[5]), (903, "one two"), (904, "one three")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    root = {(r.doc_id): r.component_id for r in simhash.similar(docs).where("doc_id is not null").collect()}
    near = far = hit = wrong = 0
    for (i, a), (j, b) in combinations([r for r in rows if r[0] is not None and r[0] < 900], 2):
        share = jaccard(a, b)
        near, hit = near + (share >= 0.8), hit + (share >= 0.8 and root[i] == root[j])
        far, wrong = far + (share < 0.4), wrong + (share < 0.4 and root[i] == root[j])
    assert near > 60 and hit >= 0.95 * near and wrong == 0 and far > 1000
    assert root[900] == root[0] and root[901] == root[902] == 901 and root[903] != root[904]
    kept = simhash.keep_one_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.keep_one_similar(docs.limit(0)).count() == 0


def test_large_buckets_of_wide_fingerprints_are_met_in_blocks(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    codes = spark.createDataFrame([(i, simhash.wide_fingerprint(t.encode().split())) for i, t in rows], "v long, code binary")
    from deedloom.llm.components import components

    found = components(simhash.wide_edges(simhash.bands(codes, limit=64)))
    assert found.count() == 300 and found.select("root").distinct().count() == 1
