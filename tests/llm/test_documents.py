"""Operators over documents against plain restatements, on rows with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from deedloom.llm import decontaminate, license_scan, lm_score, quality_classifier, quality_rules, simhash, source_mix, token_count

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fp long, root long, words string, size string, "
    "rank int, found string, id int, kept string, spans int, items int, uid int, rule string"
)


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


def row(doc_id, text, source="s1"):
    return (doc_id, text, "en", source, len(text or ""), 7, 7, "x", "y", 1, "z", 3, "k", 4, 5, 6, "r")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    long_text = prose(rng, 30000)
    base = [prose(rng, n) for n in (12, 40, 200, 90)]
    out = [
        row(1, base[0]), row(2, base[0], "s2"), row(2, base[0], "s2"), row(3, None, None), row(4, ""), row(None, base[1], "s3"), row(None, base[1], "s3"), row(None, None),
        row(5, " \n\t "), row(6, "one"), row(7, "ONE"), row(8, "one two"), row(9, base[2] + " " + base[2]), row(10, long_text, "s2"), row(11, long_text + " Tail", "s2"),
        row(12, "a b c d e f g h i j\n" * 4, "s3"), row(13, "Éa É! ÄÖ-x_y\u00a0z w\x00v", "é"), row(14, "#*$%&|<>[] <<a>> \nx\nx\n \n\nx", "Z"),
        row(15, "Released under the MIT License. Licensed under CC BY-NC 4.0, or the Apache License, Version 2.0", "s9"),
        row(16, "under the mit license under the MIT license apache license version 2 cc by nc cc by nc", "s9"),
        row(17, "This work is licensed under the GNU General Public License, version 3.", "s9"), row(18, "mit apache gpl", "s9"),
        row(19, "emoji 😀😀 漢字 ▁mark  two  blanks", "s9"), row(20, base[3].replace("w1 ", "W1 ")), row(21, base[3]),
    ]
    return out + [row(100 + i, prose(rng, rng.randint(1, 120)), rng.choice(["s1", "s1", "s2", None])) for i in range(150)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def blank(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def item(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def same(df, names, expected):
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert got == sorted(expected, key=repr)


# ---- near-duplicates


def code(text):
    import xxhash

    w = blank(lowered(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(codes):
    """Component number of each code, by comparing all pairs."""
    parent = list(range(len(codes)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(codes))]


def expected_components(pairs):
    codes = [c for _, c in pairs]
    part = groups(codes)
    low = {}
    for (d, _), p in zip(pairs, part):
        low[p] = min((x for x in (low.get(p), d) if x is not None), default=None)
    return [(d, f"{c:016x}", low[p]) for (d, c), p in zip(pairs, part)]


def test_simhash(docs, rows, none):
    same(simhash.near_duplicates(docs), ("doc_id", "fingerprint", "component_id"), expected_components([(r[0], code(r[1])) for r in rows]))
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_keeps_one_of_each_component(docs, rows, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    pairs = expected_components([(r[0], code(r[1])) for r in rows])
    part = groups([int(f, 16) for _, f, _ in pairs])
    codes = [code(r.text) for r in kept.collect()]
    by_code = {int(p[1], 16): g for p, g in zip(pairs, part)}
    assert sorted(by_code[c] for c in codes) == sorted(set(part))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in pairs}
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("limit,levels", [(16, 1), (16, 2), (8, 3), (1024, 3)])
def test_hot_buckets_lose_no_link(spark, limit, levels):
    """Buckets far above the limit are split again and met in blocks; components stay those of all pairs."""
    rng = random.Random(limit + levels)
    codes = [rng.getrandbits(64) for _ in range(40)]
    hot = rng.getrandbits(64)
    codes += [hot ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(260)]
    codes += [c ^ 1 << rng.randrange(64) for c in codes[:30]]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
    from deedloom.llm.components import components

    root = {r.v: r.root for r in components(simhash.edges(simhash.buckets(df, limit, levels))).collect()}
    got, want = {}, {}
    for c, p in zip(codes, groups(codes)):
        got.setdefault(root.get(simhash.signed(c), simhash.signed(c)), set()).add(c)
        want.setdefault(p, set()).add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# ---- decontamination


def leaks(docs, bench):
    wins = {}
    for i, text in bench:
        w = item(text)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).update({i} - {None})
    out = []
    for r in docs:
        w, hit, ids = item(r[1]), set(), set()
        for n in {len(k) for k in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    ids |= wins[tuple(w[a : a + n])]
        joined = ",".join(sorted(map(str, ids)))
        out.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, rows, none, monkeypatch):
    rng = random.Random(9)
    passage = prose(rng, 40)
    bench = [(1, passage), (2, passage), (2, passage), (30, "tiny item"), (4, None), (5, ""), (None, "no id but ten words are in this item here x"), (6, "É!ä"), (7, "- -")]
    more = [row(300 + i, f"{prose(rng, 5)} {' '.join(passage.split()[i:i + 12]).upper()}, tail") for i in range(30)]
    more += [row(400, "TINY-item tiny item"), row(401, "so no id but ten words are in this item here x"), row(402, (passage + " gap ") * 300), row(403, "é É ä"), row(404, passage.replace(" ", "\x00"))]
    every, items = docs.unionByName(spark.createDataFrame(more, SCHEMA)), spark.createDataFrame(bench, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = leaks(rows + more, bench)
    same(decontaminate.report(decontaminate.contamination(every, items)), names, want)
    kept = decontaminate.clean(every, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)
    # several blocks of the benchmark, several shards in a task
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    monkeypatch.setattr(decontaminate, "SHARD_TOKENS", 500)
    same(decontaminate.report(decontaminate.contamination(every, items)), names, want)
    assert decontaminate.report(decontaminate.contamination(none, items)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(rows)


# ---- licenses


def test_licenses(docs, rows, none):
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    want = []
    for r in rows:
        w = item(r[1])
        at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in at]
        want.append((r[0], len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at}))))
    found = license_scan.scan(docs).cache()
    same(found, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"), want)
    labels = {r.doc_id: (r.labels, r.score) for r in found.collect()}
    assert labels[17] == ("gpl-3", 0.9) and labels[18] == ("", 0.0) and labels[15] == ("apache-2,cc-by-nc,mit", 0.9)
    assert all(0 <= s <= 1 for _, s in labels.values()) and all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in found.collect() if r.base_labels)
    # a detection inside a stronger one is left out
    gpl = next(r for r in found.collect() if r.doc_id == 17).detections
    assert [(d.start, d.end, d.label) for d in gpl] == [(3, 12, "gpl-3")]
    assert len(license_scan.rules()) > 200 and license_scan.scan(none).count() == 0


def _sample(before, key, after):
    """A text that a signature fits: optional groups left out, the first of several alternatives taken."""
    out = before + key + " " + after
    out = re.sub(r"\(\?:[^()]*\)[?*]", "", out)
    out = re.sub(r"\(\?:([^()|]*)[^()]*\)", r"\1", out)
    out = out.replace("[1-4] [05]", "4 0").replace("licen[sc]es?", "licenses").replace("[123]", "2").replace("[23]", "3").replace(" ?", " ")
    return out.replace("(?:v20", "v20").strip()


def test_license_signatures(spark):
    table = [s for s in license_scan.signatures() if s[0]]
    assert len(table) > 200 and len({s[1:4] for s in table}) == len(table)
    texts = [_sample(before, key, after) for _, key, before, after, _ in table]
    # a signature is found in its own text, even where other words surround it, and not without its first or last word
    rows = [(i, f"Some words. {t.capitalize()}, and more") for i, t in enumerate(texts)]
    rows += [(10_000 + i, t.rsplit(" ", 1)[0]) for i, t in enumerate(texts)] + [(20_000 + i, t.split(" ", 1)[1]) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [(s[0], t, found[i].labels) for i, (s, t) in enumerate(zip(table, texts)) if s[0] not in found[i].labels.split(",")]
    assert not missed
    for i, s in enumerate(table):
        for at in (10_000 + i, 20_000 + i):
            assert all(d.label != s[0] or d.end - d.start < len(texts[i].split()) for d in found[at].detections)


def test_license_texts_and_negations(spark):
    probes = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit", 0.85),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd", 0.85),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", 0.85),
        ("This is free and unencumbered software released into the public domain.", "unlicense", 0.85),
        ("see https://www.apache.org/licenses/LICENSE-2.0", "apache-2", 0.92),
        ("Copyright (c) 2020. All rights reserved.", "all-rights-reserved", 0.4),
        ("This is not licensed under the GPL.", "", 0.0),
        ("It was never released under the terms of the GNU General Public License version 3.", "", 0.0),
        ("not licensed under the GPL but licensed under the Apache License, Version 2.0", "apache-2", 0.9),
        ("It is not available under the MIT license", "mit", 0.0),
        ("redistribution of the permission was hereby refused to any person", "", 0.0),
    ]
    found = license_scan.scan(spark.createDataFrame([(i, p[0]) for i, p in enumerate(probes)], "doc_id long, text string"))
    assert [(r.labels, r.score) for r in found.orderBy("doc_id").collect()] == [(p[1], p[2]) for p in probes]


def test_license_suppression_in_a_long_text(spark):
    """Suppression is local, so a text of many mentions is judged like its parts."""
    part = "licensed under the gnu general public license version 3 and released under the mit license "
    one, many = (license_scan.scan(spark.createDataFrame([(1, part * n)], "doc_id long, text string")).first() for n in (1, 2000))
    assert len(many.detections) == 2000 * len(one.detections) and many.n_base == 2000


# ---- quality rules


def test_quality_rules(docs, rows, none):
    want = []
    for r in rows:
        text = r[1] or ""
        w = blank(text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if blank(x)]
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "[#*$%&|<>]"[1:-1] for c in text), len(lines) - len(set(lines)), len(rep), failed))
    found = quality_rules.judge(docs).cache()
    same(found, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), want)
    assert found.where("base_failed and kept").count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in found.where("kept").collect()), key=repr)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_compression_bands(spark):
    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(33, 0x2FF)) + " " * (rng.random() < 0.15) for _ in range(9000))
    cycle = " ".join(f"w{i % 700}" for i in range(60000))
    mixed = prose(rng, 1500) + " " + " ".join(["same"] * 9000)
    texts = [(1, prose(rng, 3000)), (2, noise), (3, cycle), (4, prose(rng, 30)), (5, mixed)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_compression_bands_reject_noise_and_repeats_of_every_length(spark):
    rng = random.Random(6)

    def lines(text, n):
        return "\n".join(text[i : i + 24] for i in range(0, len(text), 24))[:n]

    def base64_lines(n):
        return lines(base64.b64encode(rng.randbytes(n)).decode(), n)

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").groupBy("doc_id").agg({"quality": "min"}).where("`min(quality)` = 1")
    clean = quality_rules.judge(docs).join(good, "doc_id").where("not base_failed")
    assert clean.where("kept").count() >= 0.995 * clean.count()

    long = max((r.text for r in docs.join(good, "doc_id").orderBy("doc_id").limit(2000).collect()), key=len)
    assert len(long) > 12000
    bad = [base64_lines(n) for n in (320, 500, 900, 1023, 2000, 5000, 60000)]
    bad += [lines(rng.randbytes(n).hex(), n) for n in (3500, 5000, 20000)]
    bad += [" ".join(f"row {i} of the table" for i in range(n)) for n in (30, 100, 400, 1500)]
    bad += [long[:4200] + " " + base64_lines(3900), long[:8192] + " " + base64_lines(4095), (long * 5)[:31000] + base64_lines(29000)]
    bad += [long[:4096] + " " + base64_lines(4090)]
    found = quality_rules.judge(spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.doc_id for r in found if r.kept] == []
    # a short noise in a long text is no reason
    assert quality_rules.judge(spark.createDataFrame([(1, long[:9000] + "\n" + base64_lines(200))], "doc_id long, text string")).first().kept


# ---- tokens


def test_token_counts(docs, rows, none):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.VOCABULARY)
    pieces = token_count.load()
    low = min(s for _, s in pieces)
    vocabulary = [("<unk>", low), *pieces, *((sp.id_to_piece(i), low) for i in range(sp.get_piece_size()) if sp.is_byte(i))]
    known = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    known.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    want = [(r[0], len(r[1] or ""), len(known.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    same(token_count.count(docs), ("doc_id", "n_chars", "n_tokens"), want)
    assert token_count.count(none).count() == 0


def test_token_ties_and_best_score():
    """Against all segmentations; of equal scores the last piece that starts first wins."""
    rng = random.Random(3)
    pieces = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aab", -2.5), ("▁a", -3.0), ("bb", -1.5)]
    score, counting = dict(pieces), token_count.Counting(pieces)

    def best(word):
        state = {0: (0.0, 0)}
        for end in range(1, len(word) + 1):
            options = [(state[s][0] + score[word[s:end]], -s, state[s][1] + 1) for s in range(end) if word[s:end] in score]
            if word[end - 1] not in score:
                options.append((state[end - 1][0] + min(score.values()) - 10, 1 - end, state[end - 1][1] + len(word[end - 1].encode())))
            top = max(options)
            state[end] = (top[0], top[2])
        return state[len(word)]

    for _ in range(300):
        word = "▁" + "".join(rng.choice("aabbé") for _ in range(rng.randint(0, 12)))
        assert counting.word(word) == best(word)
    # whole texts with runs of blanks, with a vocabulary of runs and with one whose pieces lie across marks
    for more in ([("▁▁", -1.5), ("▁▁▁", -4.0)], [("▁▁", -1.5), ("b▁a", -1.0)]):
        score = dict(pieces + more)
        counting = token_count.Counting(pieces + more)
        for _ in range(300):
            text = "".join(rng.choice("aab  é") for _ in range(rng.randint(1, 14)))
            marked = text.replace(" ", "▁")
            want = best(marked if marked[0] == "▁" else "▁" + marked)
            words, tokens, total = counting.text(text)
            assert (words, tokens) == (len(text.split()), want[1]) and math.isclose(total, want[0])
    assert token_count.Counting(token_count.load()).text("a    b")[1] == 3


# ---- classifier


def test_classifier_edge_cases(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (None, 1, 0, "x"), (10, 1, None, "x"), (10, 1, 1, "x"), (9, 0, 0, "x"), *((100 + i, 1, 0, "x") for i in range(90))], "doc_id long, quality int, toxic int, text string")
    found = quality_classifier.judge(docs, labels).cache()
    assert sorted((r.doc_id for r in found.collect()), key=repr) == sorted((r[0] for r in rows), key=repr)
    assert all(math.isfinite(r.key) == bool(r.n_words) and r.n_words == len(blank(t[1])) for r in found.collect() for t in rows if r.doc_id == t[0] is not None)
    twins = found.where("doc_id = 2").collect()
    assert len(twins) == 2 and twins[0] == twins[1]
    kept = quality_classifier.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count() > 100
    assert quality_classifier.judge(docs, labels.limit(0)).where("kept").count() == sum(bool(blank(r[1])) for r in rows)
    assert quality_classifier.judge(none, labels).count() == 0


def test_classifier_held_out_accuracy(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = l.where("doc_id % 2 = 0"), l.where("doc_id % 2 = 1")
    found = {(r.quality, r.kept): r["count"] for r in quality_classifier.judge(d, train).join(test, "doc_id").groupBy("quality", "kept").count().collect()}
    good, bad = (found.get((q, True), 0) / (found.get((q, True), 0) + found.get((q, False), 0)) for q in (1, 0))
    assert good >= 0.98 and bad <= 0.15


def test_classifier_rejects_bad_documents_of_every_length(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = l.where("doc_id % 2 = 0"), l.where("doc_id % 2 = 1")
    band = "CASE WHEN n_words <= 100 THEN 0 WHEN n_words <= 200 THEN 1 WHEN n_words <= 1000 THEN 2 ELSE 3 END"
    rows = quality_classifier.judge(d, train).join(test, "doc_id").selectExpr("quality", f"{band} AS band", "double(kept) AS kept").groupBy("quality", "band").avg("kept").collect()
    share = {(r[0], r[1]): r[2] for r in rows}
    assert share[0, 0] <= 0.35 and all(share[0, b] <= 0.05 for b in (1, 2, 3)), share
    assert all(share[1, b] >= 0.97 for b in range(4)), share


# ---- language model


def test_lm_score(docs, rows, none):
    tokens = {i: [*blank(lowered(r[1])), None] for i, r in enumerate(rows)}
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = Counter(t for i, w in tokens.items() if not out[i] for t in w)
    total, kinds = counts.total(), len(counts)
    want = [
        (r[0], out[i], len(tokens[i]), sum(counts[t] > 0 for t in tokens[i]), total, round(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens[i]), 5))
        for i, r in enumerate(rows)
    ]
    for options in ({}, {"hot": 20, "bucket_keys": 5000}, {"hot": 20, "bucket_keys": 5000, "filter_bytes": 0}):
        found = lm_score.score(docs, **options)
        got = [(*r[:5], round(r[5], 5)) for r in found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    direct = sorted(round(r.score, 9) for r in lm_score.score(docs, bucket_keys=5000).collect())
    assert direct == sorted(round(r.score, 9) for r in lm_score.score(docs, bucket_keys=5000, filter_bytes=0).collect())
    # pieces copied to many tasks answer the same
    assert direct == sorted(round(r.score, 9) for r in lm_score.score(docs, bucket_keys=5000, filter_bytes=0, ask_bytes=2000).collect())
    assert max(direct) < 0 and lm_score.score(none).count() == 0


def test_lm_score_restated(docs, rows):
    """The score with whole numbers and a set of bits instead of arrays, for one piece."""
    import xxhash

    top = 2**64 - 1
    a, b, c = (int(x) for x in (lm_score.A, lm_score.B, lm_score.C))

    def mix(x):
        x = ((x ^ (x >> 32)) * c) & top
        return x ^ (x >> 29)

    def keys(text):
        codes = [xxhash.xxh3_64_intdigest(w) for w in (b" start", *(w.encode() for w in blank(lowered(text))), b" end")]
        return list(map(mix, codes)), [mix((x * a + (y ^ b)) & top) for x, y in zip(codes, codes[1:])]

    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    each = [keys(r[1]) for r in rows]
    counts = Counter(k for (single, pair), held in zip(each, out) if not held for k in (*single, *pair))
    tokens = Counter(t for r, held in zip(rows, out) if not held for t in (*blank(lowered(r[1])), None))
    size = max(64, 8 * sum(n.bit_length() for n in counts.values()))

    def places(key, level):
        x, y = mix((key * a) & top), mix(key ^ b) | 1
        return [((((x + (level * 4 + i) * y) & top) >> 32) * size) >> 32 for i in range(4)]

    bits = {p for key, n in counts.items() for level in range(1, n.bit_length() + 1) for p in places(key, level)}

    def middle(key):
        level = 0
        while bits.issuperset(places(key, level + 1)):
            level += 1
        return (3 * 2 ** (level - 1) - 1) / 2 if level else 0.0

    want = []
    for (single, pair), r in zip(each, rows):
        total = 0.0
        for before, word, both in zip(map(middle, single), map(middle, single[1:]), map(middle, pair)):
            alone = (word + 1) / (tokens.total() + len(tokens) + 1)
            total += math.log10((both + 2 * alone) / (max(before, both) + 2))
        want.append((r[0], round(total, 6)))
    assert sorted(want, key=repr) == sorted(((r.doc_id, round(r.score, 6)) for r in lm_score.score(docs).collect()), key=repr)


def test_lm_filter_levels():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20000, dtype=np.uint64))
    counts = rng.integers(1, 5000, len(keys))
    pieces = {b: lm_score.build_piece(keys[keys % np.uint64(3) == b], counts[keys % np.uint64(3) == b]) for b in range(3)}
    held = lm_score.Filter(pieces.items(), 3)
    level, exact = held.levels(keys), np.floor(np.log2(counts)).astype(int) + 1
    assert (level >= exact).all() and (level == exact).mean() > 0.95
    assert (held.levels(rng.integers(0, 2**63, 20000, dtype=np.uint64)) > 0).mean() < 0.05


def test_lm_prefers_the_training_language(spark):
    rng = random.Random(4)
    seen = [(i, prose(rng, 100)) for i in range(200)]
    a, b = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    odd = [(a, "w1 w2 w3 w4 w5 w6"), (b, "q1 q2 q3 q4 q5 q6")]
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(seen + odd, "doc_id long, text string")).collect()}
    assert got[a] > got[b]


# ---- source mix


def test_apportionment():
    rng = random.Random(1)
    for _ in range(400):
        w, n = [rng.choice([0, 1, 2, 7, 100, rng.randint(0, 5000)]) for _ in range(rng.randint(1, 9))], rng.randint(0, 70)
        seats = [0] * len(w)
        for _ in range(n if any(w) else 0):
            best = max(range(len(w)), key=lambda i: (w[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        assert source_mix.apportion(n, w) == seats


def test_source_mix(docs, rows, none):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(blank(r[1]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else (total - sum(2 * sizes[c] for c in capped)) * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    found = source_mix.mix(docs).collect()
    assert sorted(((r.doc_id, r.size, r.source, r.source_size) for r in found), key=repr) == sorted(((r[0], len(blank(r[1])), r[3], sizes[r[3]]) for r in rows), key=repr)
    assert all(0 <= r.taken <= 2 * r.size and math.isclose(r.target, target[r.source], rel_tol=1e-9) for r in found)
    for s in order:
        assert abs(sum(r.taken for r in found if r.source == s) - target[s]) <= 2 * source_mix.BLOCK + 0.005 * target[s]
    again = source_mix.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.source, r.taken) for r in again) == Counter((r.doc_id, r.size, r.source, r.taken) for r in found)
    assert source_mix.mix(none).count() == 0


def test_source_mix_with_many_sources_and_shards(spark, monkeypatch):
    """Deep quota trees: more sources and shards than children of a node."""
    monkeypatch.setattr(source_mix, "FAN", 4)
    monkeypatch.setattr(source_mix, "SHARD_WORDS", 200)
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 11}" if i % 3 else "hot") for i in range(900)]
    found = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(found) == 900 and all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())
