"""Fill-in-the-middle, exact top-k and collocations against plain restatements."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from deedloom.llm import collocations, fill_middle, top_k


def split_text(doc_id, text):
    """(n, form, prefix, middle, output) by slicing."""
    t = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(t), "spm" if h4 % 100 < 20 else "psm", a, b - a, out


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_fill_middle_against_slicing(spark, monkeypatch, size):
    rng = random.Random(7)
    texts = [None, "", "a", "x<P>y", "<M>", "<S", "é😀 " * 3000, "long text " * 40000]
    texts += ["".join(rng.choice("ab<>PSMé😀 \n") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    rows = [(i, t, "output") for i, t in enumerate(texts)] + [(None, "no id", "x"), (5, texts[5], "x"), (5, texts[5], "x")]
    monkeypatch.setattr(fill_middle, "SLICE", size)
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    got = fill_middle.restore(fill_middle.transform(docs)).collect()
    want = Counter((i, *split_text(i, t), t or "") for i, t, _ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_digests_and_empty(spark):
    docs = spark.createDataFrame([(3, "some words to cut")], "doc_id long, text string")
    (r,) = fill_middle.digests(docs).collect()
    assert r.output_sha256 == hashlib.sha256(split_text(3, "some words to cut")[4].encode()).hexdigest()
    assert r.restored_sha256 == hashlib.sha256(b"some words to cut").hexdigest()
    assert fill_middle.digests(docs.limit(0)).count() == 0


def best_rows(rows, k=20):
    usable = [(i, [math.floor(64 * x) for x in e]) for i, e, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, e) in enumerate(usable):
        if i is not None and i % 20 == 0:
            others = [(-sum(a * b for a, b in zip(e, f)), j is None, j or 0, j) for m, (j, f) in enumerate(usable) if m != n]
            out += [(i, r + 1, t[3], -t[0]) for r, t in enumerate(sorted(others, key=lambda t: t[:3])[:k])]
    return Counter(out)


VECTORS = "vec_id long, embedding array<double>, c int, v string, score long"


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_top_k_against_all_pairs(spark, monkeypatch, chunk):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(300)]
    hot = [0.1] * 8
    rows += [(1000 + i, hot) for i in range(90)]
    rows += [(20, [0.3] * 8), (20, rows[20][1]), (20, rows[20][1]), (None, hot), (None, [0.9] * 8), (40, None), (60, [0.1, None]), (80, [math.nan] * 8)]
    rows += [(81, [math.inf] * 8), (2000, [0.5, 0.5]), (2020, []), (3000, [1e3] * 8)]
    monkeypatch.setattr(top_k, "CHUNK", chunk)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(3)
    assert Counter(tuple(r) for r in top_k.top_k(df).collect()) == best_rows(rows)


def test_top_k_few_rows_and_wide_numbers(spark):
    rows = [(0, [1e6, 2.0]), (20, [1e6, -2.0]), (3, [-1e7, 0.5])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    assert Counter(tuple(r) for r in top_k.top_k(df).collect()) == best_rows(rows)
    assert top_k.top_k(df.limit(0)).count() == 0


def test_search_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    made, at = [], 0
    for centre in (0, 40, -40, 80):
        for _ in range(4):
            v = rng.integers(centre - 3, centre + 4, (16, 6))
            made.append((np.arange(at, at + 16), list(range(at, at + 16)), v.ravel(), v.max(0), v.min(0)))
            at += 16
    queries = rng.integers(1, 5, (5, 6))
    every = np.concatenate([b[2].reshape(-1, 6) for b in made]) @ queries.T
    best, scored = top_k.search(made, queries, np.full(5, np.iinfo(np.int64).min), 7)
    for q in range(5):
        order = sorted(range(at), key=lambda i: (-every[i, q], i))[:7]
        mine = best.rows[0] == q
        assert best.rows[2][mine].tolist() == order and best.rows[1][mine].tolist() == [every[i, q] for i in order]
    # clusters far below the best ones are abandoned
    assert scored < 5 * len(made) * 0.6


def collocated(rows, support, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        inside = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * c[p[i : i + k]]}
        scored = []
        for p in set(cand) - inside:
            s, _, left, right = min((2000000 * c[p] // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -c[p], " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("size, support", [(1 << 21, 30), (3000, 12)])
def test_collocations_against_counting(spark, monkeypatch, size, support):
    monkeypatch.setattr(collocations, "SLICE", size)
    monkeypatch.setattr(collocations, "ID_BLOCK", 16)
    monkeypatch.setattr(collocations, "RANGE", 5000)
    rng = random.Random(1)
    words = ["alpha", "Beta", "gam\x00ma", "é", "Ét", "x", "y", "zz", "a b"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "!", "  "]) for _ in range(rng.randint(0, 60)))
    rows = [(i, rng.choice(["en", "en", "de", None, "und"]), text()) for i in range(300)]
    rows += [(None, "en", None), (7, "en", ""), (8, "fr", None), (11, "es", "one two three four. " * 20000)] + [(9, "en", "Same words of a copied text here")] * 50
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, lang string, text string, phrase string, f int").repartition(4)
    got = Counter(tuple(r) for r in collocations.collocations(docs, support).collect())
    assert got == collocated([(lang, t) for _, lang, t in rows], support) and len(got) > 40
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_limit(spark):
    rows = [(i, "en", "a b. a b c. b c d e. c d") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = Counter(tuple(r) for r in collocations.collocations(docs, top=2).collect())
    assert got == collocated([(lang, t) for _, lang, t in rows], 30, 2)
