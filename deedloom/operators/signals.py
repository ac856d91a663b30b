"""Signals of register records, chunk scoring and candidate selection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from deedloom import fixed
from deedloom.functions import dates as D, text as T
from deedloom.operators.beside import beside
from deedloom.operators.positions import first_per_key, position
from deedloom.session import materialize

CHUNK = ("case_id", "document_id", "chunk_index")
DOC = ("case_id", "document_id")


def scoring_rules(spark: SparkSession) -> DataFrame:
    """Constant table of signal types with the selection limits (SRC-10)."""
    rows = [(i, t, *meta, fixed.MIN_SCORE, fixed.CONTEXT_WINDOW, fixed.MAX_CANDIDATE_CHUNKS, fixed.MAX_CANDIDATE_CHARS)
            for i, (t, meta) in enumerate(fixed.SCORING_RULES.items())]
    return spark.createDataFrame(
        rows,
        "rule_order int, signal_type string, label string, weight int, description string, minimum_score int, "
        "context_window int, max_candidate_chunks int, max_candidate_chars int",
    )


def _by_type(field: int, c: Column) -> Column:
    out = F.lit(None)
    for t, meta in fixed.SCORING_RULES.items():
        out = F.when(c == t, F.lit(meta[field])).otherwise(out)
    return out


def _type_order(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, t in enumerate(fixed.SCORING_RULES):
        out = F.when(c == t, F.lit(i)).otherwise(out)
    return out


def record_signals(records: DataFrame) -> DataFrame:
    """Signals of each record, one row each, in a single pass over the records (GEN-07)."""
    signal = lambda kind, value, shown: F.struct(
        F.lit(kind).alias("signal_type"), value.alias("normalized_value"), shown.alias("display_value")
    )
    only = lambda cond, s: F.when(cond, F.array(s))
    none = F.array().cast("array<struct<signal_type:string,normalized_value:string,display_value:string>>")
    akt, ref = F.col("akt_nr"), F.col("date_reference")
    serial = D.date_components(ref)["lob_suffix"]
    words = F.transform(
        F.split(F.lower("title"), "[" + fixed.BLANK + "]+"), lambda w: F.regexp_replace(w, "[^" + fixed.WORD + "]", "")
    )
    long_words = F.filter(words, lambda w: (F.length(w) >= fixed.TITLE_WORD_MIN) & ~w.isin(*fixed.TITLE_STOPWORDS))
    parts = [
        only(akt != "", signal("akt_nr", T.archive_key(akt), akt)),
        only(ref != "", signal("date_ref", T.match_key(ref), ref)),
        only(serial.isNotNull(), signal("lob_suffix", T.match_key(serial), serial)),
        F.transform("applies_to_matrikler", lambda m: signal("matrikel", F.lower(m), F.lower(m))),
        F.transform(long_words, lambda w: signal("title_word", w, w)),
    ]
    every = F.concat(*[F.coalesce(p, none) for p in parts])
    kept = F.array_distinct(F.filter(every, lambda s: F.coalesce(s["normalized_value"], F.lit("")) != ""))
    keep = [c for c in ("case_id", "ord", "servitut_id", "date_reference", "title", "akt_nr") if c in records.columns]
    return records.select(*keep, F.explode(kept).alias("_s")).select(*keep, "_s.*").withColumn(
        "signal_key", F.concat_ws(":", "signal_type", "normalized_value")
    )


def signal_catalog(signals: DataFrame) -> DataFrame:
    """One row per signal of a case with its spellings and the number of records behind it (AGG-09)."""
    refs = F.count_distinct(
        F.coalesce("date_reference", F.lit(fixed.EMPTY_CELL)), F.coalesce("title", F.lit(fixed.EMPTY_CELL)),
        F.coalesce("akt_nr", F.lit(fixed.EMPTY_CELL)),
    )
    grouped = signals.groupBy("case_id", "signal_type", "normalized_value").agg(
        F.array_sort(F.collect_set("display_value")).alias("display_values"), refs.alias("canonical_refs")
    )
    t = F.col("signal_type")
    return grouped.withColumns(
        {
            "signal_key": F.concat_ws(":", "signal_type", "normalized_value"),
            "label": _by_type(0, t).cast("string"),
            "weight": _by_type(1, t).cast("int"),
            "description": _by_type(2, t).cast("string"),
        }
    )


def signal_groups(catalog: DataFrame, cases: DataFrame, examples: int = 5) -> DataFrame:
    """Signals per case and type with the first examples; types without signals show zero (AGG-08, AGG-27, SRT-06)."""
    shown = F.array_join("display_values", ", ")
    head = first_per_key(
        catalog.select("case_id", "signal_type", "normalized_value", shown.alias("_x")),
        ["case_id", "signal_type"], ["normalized_value"], examples,
    )
    samples = head.groupBy("case_id", "signal_type").agg(F.array_sort(F.collect_list(F.struct("normalized_value", "_x"))).alias("_l"))
    counts = catalog.groupBy("case_id", "signal_type").agg(F.count(F.lit(1)).alias("_n"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(t).alias("signal_type"), F.lit(m[0]).alias("label"), F.lit(m[1]).alias("weight"), F.lit(m[2]).alias("description"))
        for t, m in fixed.SCORING_RULES.items()
    ]))
    grid = cases.select("case_id").distinct().select("case_id", rules.alias("_r")).select("case_id", "_r.*")
    text = F.array_join(F.transform("_l", lambda x: x["_x"]), " | ")
    return grid.join(counts, ["case_id", "signal_type"], "left").join(samples, ["case_id", "signal_type"], "left").select(
        "case_id", "signal_type", "label", "weight", "description",
        F.coalesce("_n", F.lit(0)).alias("count"),
        F.coalesce(F.nullif(text, F.lit("")), F.lit(fixed.EMPTY_CELL)).alias("examples"),
    )


def describe_records(records: DataFrame, signals: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records with display defaults and their signals as one text (JN-15, AGG-27)."""
    mine = signals.select("case_id", "servitut_id", "signal_type", "normalized_value").distinct()
    named = mine.join(
        catalog.select("case_id", "signal_type", "normalized_value", "label", "weight", "display_values"),
        ["case_id", "signal_type", "normalized_value"],
    )
    shown = F.concat(
        F.col("label"), F.lit(" ("), F.col("weight").cast("string"), F.lit("): "), F.array_join("display_values", ", ")
    )
    each = F.struct(_type_order(F.col("signal_type")).alias("o"), F.col("normalized_value").alias("v"), shown.alias("x"))
    lists = named.groupBy("case_id", "servitut_id").agg(F.array_sort(F.collect_list(each)).alias("_l"))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(fixed.EMPTY_CELL)).alias(c)
    text = F.array_join(F.transform("_l", lambda s: s["x"]), " | ")
    return records.join(lists, ["case_id", "servitut_id"], "left").select(
        "case_id", "servitut_id", dash("date_reference"), dash("title"), dash("akt_nr"), dash("raw_scope_text"),
        F.coalesce(F.array_join("applies_to_matrikler", ", "), F.lit("")).alias("applies_to_matrikler"),
        F.coalesce(text, F.lit(fixed.EMPTY_CELL)).alias("derived_signals"),
    )


# Containment without comparing every chunk with every signal of its case: a signal is known by a short piece
# of it, its anchor: up to eight characters from its first digit on; the digit with the character before it
# where the signal ends there; six letters of a title word; the first characters where there is no digit.
# The signals of a case are read beside its chunks (`beside`): the pieces of a chunk are looked up among the anchors, and the few
# signals met are looked up whole. So no length is lost, and no pair of a chunk and a signal is shuffled.
# A title word has word characters only, so it lies inside one word of the text: a chunk sends its distinct words,
# and a word that came before is known.
_LENGTHS = (1, 2, 4, 8)
_WORDS = r"[" + fixed.WORD + r"]{%d,}" % fixed.TITLE_WORD_MIN
_DIGIT = re.compile("[0-9]")


def _anchor(value: Column, title: Column) -> Column:
    """kind and text of the anchor of a signal."""
    before = F.length(F.regexp_extract(value, r"(?s)^[^0-9]*", 0))
    tail = F.substring(value, before + 1, F.lit(_LENGTHS[-1]))

    def first(c: Column) -> Column:
        k = F.lit(_LENGTHS[0])
        for n in _LENGTHS[1:]:
            k = F.when(F.length(c) >= n, F.lit(n)).otherwise(k)
        return F.left(c, k)

    piece = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("anchor"))
    return (
        F.when(title, piece("word", F.left(value, F.lit(fixed.TITLE_WORD_MIN))))
        .when(F.length(tail) == 0, piece("plain", first(value)))
        .when((F.length(tail) == 1) & (before > 0), piece("tail", F.substring(value, before, F.lit(2))))
        .otherwise(piece("digit", first(tail)))
    )


class _Signals:
    """The signals of a group by their anchors, in the order (o, k, x)."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: r[:3])
        self.weights, self.lists = [r[3] for r in rows], pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string()))], names=["o", "k", "x"]
        )
        self.by: dict[str, dict[str, list]] = {}
        for i, (_, _, _, _, cls, anchor, value) in enumerate(rows):
            self.by.setdefault(cls, {}).setdefault(anchor, []).append((value, i))
        self.known: dict[str, list] = {}

    def of_word(self, word: str) -> list:
        """Title words inside a word."""
        found = self.known.get(word)
        if found is None:
            titles, n = self.by.get("lower:word", {}), fixed.TITLE_WORD_MIN
            found = [i for at in range(len(word) - n + 1) for value, i in titles.get(word[at : at + n], ()) if word.startswith(value, at)]
            if len(self.known) < _WORDS_KEPT:
                self.known[word] = found
        return found

    def of_text(self, form: str, text: str) -> set:
        """Other signals inside a text."""
        found = set()

        def look(kind: str, places: list[int], before: int) -> None:
            anchors = self.by.get(f"{form}:{kind}")
            if anchors:
                for k in {len(a) for a in anchors}:
                    for piece in {text[at - before : at - before + k] for at in places if at >= before}:
                        found.update(i for value, i in anchors.get(piece, ()) if value in text)

        digits = [m.start() for m in _DIGIT.finditer(text)]
        look("digit", digits, 0)
        look("tail", digits, 1)
        if f"{form}:plain" in self.by:
            look("plain", range(len(text)), 0)
        return found


# words of a group whose title words are remembered
_WORDS_KEPT = 1 << 18
_INDEX = ("o", "k", "x", "w", "cls", "anchor", "value")


def _matcher(listed: bool) -> Callable:
    """For every chunk that has any, the weight of the signals it contains and, if `listed`, the signals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, signals, rows, out = None, None, [], {}

        def send() -> Iterator[pa.RecordBatch]:
            hits = [(*at, sorted(s)) for at, s in out.items() if s]
            out.clear()
            if hits:
                columns = [pa.array([group[0]] * len(hits)), pa.array([h[0] for h in hits]), pa.array([h[1] for h in hits], pa.int32())]
                columns.append(pa.array([sum(map(signals.weights.__getitem__, h[2])) for h in hits], pa.int64()))
                if listed:
                    edges = pa.array([0, *accumulate(len(h[2]) for h in hits)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, signals.lists.take(pa.array([i for h in hits for i in h[2]], pa.int64()))))
                yield pa.RecordBatch.from_arrays(columns, names=[*CHUNK, "score", "_s"][: len(columns)])

        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).tolist()  # noqa: E731, B023
            keys = zip(column("case_id"), column("_group"), column("_piece"))
            index = zip(*map(column, _INDEX))
            texts = zip(column("document_id"), batch.column("chunk_index").to_pylist(), column("words"), column("n"), column("l"))
            for key, kind, entry, (document, at, words, n, l) in zip(keys, column("_kind"), index, texts):
                if key != group:
                    yield from send()
                    group, signals, rows = key, None, []
                if kind == 0:
                    rows.append(entry)
                    continue
                if not rows:
                    continue
                if signals is None:
                    signals = _Signals(rows)
                # rows of one chunk stand together and count as one
                if len(out) >= 1024 and (document, at) not in out:
                    yield from send()
                hits = out.setdefault((document, at), set())
                for word in words.split(" ") if words else ():
                    hits.update(signals.of_word(word))
                if n:
                    hits |= signals.of_text("joined", n)
                if l:
                    hits |= signals.of_text("lower", l)
        yield from send()

    return run


def _signal_index(signals: DataFrame) -> DataFrame:
    """Signals of each case once, with kind and text of their anchors, written."""
    value = F.col("normalized_value")
    joined = F.col("signal_type").isin("akt_nr", "date_ref", "lob_suffix")
    return materialize(
        signals.select("case_id", "signal_type", "normalized_value").distinct()
        .withColumn("_a", _anchor(value, F.col("signal_type") == "title_word"))
        .select("case_id", "signal_type", "normalized_value", F.concat_ws(":", "signal_type", "normalized_value").alias("signal_key"),
                F.coalesce(_by_type(1, F.col("signal_type")).cast("int"), F.lit(0)).alias("w"),
                F.concat(F.when(joined, "joined:").otherwise("lower:"), "_a.kind").alias("cls"), F.col("_a.anchor").alias("anchor"))
    )


def _matches(chunks: DataFrame, index: DataFrame, told: DataFrame, listed: bool) -> DataFrame:
    """Chunks that contain signals: their weight and the signals as `_s` (o, k, x), in this order.

    `told` is the index with what is told of a signal: o, k and x.
    """
    # which kinds of anchors occur, and the longest signal of each: at most eight rows, whatever the data
    used = index.groupBy("cls").agg(F.max(F.length("normalized_value")).alias("n")).collect()
    # a signal with a digit lies within its own length around that digit: of the text only this much travels
    reach = max((r.n for r in used if not r.cls.endswith((":plain", ":word"))), default=0)
    has = lambda *ends: any(r.cls.endswith(ends) for r in used)
    rows = chunks.select(*CHUNK, F.array_join(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(0))), " ").alias("words"),
                         T.match_key("text").alias("n"), F.lower("text").alias("l"))
    cut = lambda c: F.when(
        F.rlike(c, F.lit("[0-9]")), F.regexp_replace(c, r"(?s)([^0-9]{%d})[^0-9]+([^0-9]{%d})" % (reach, reach), "$1\n$2")
    )
    if has(":plain"):
        # only cases that have a signal without digits send whole texts
        bare = index.where(F.endswith("cls", F.lit(":plain"))).select("case_id", F.lit(True).alias("_bare")).distinct()
        rows = rows.join(bare, "case_id", "left").withColumns({c: F.when(F.col("_bare"), F.col(c)).otherwise(cut(c)) for c in ("n", "l")}).drop("_bare")
    else:
        rows = rows.withColumns({c: cut(c) for c in ("n", "l")})
    entries = told.select("case_id", "o", "k", "x", "w", "cls", "anchor", F.col("normalized_value").alias("value"))
    schema = "case_id string, document_id string, chunk_index int, score long" + (", _s array<struct<o:int,k:string,x:string>>" if listed else "")
    found, several = beside(entries, rows, "document_id", ["document_id", "chunk_index"], _matcher(listed), schema)
    if not several:
        return found
    lists = [F.array_sort(F.flatten(F.collect_list("_s"))).alias("_s")] if listed else []
    return found.groupBy(*CHUNK).agg(F.sum("score").alias("score"), *lists)


def _by_key(index: DataFrame) -> DataFrame:
    return index.withColumns({"o": F.lit(0), "k": F.col("signal_key"), "x": F.lit("")})


def match_signals(chunks: DataFrame, signals: DataFrame) -> DataFrame:
    """Every (chunk, signal) of a case whose text contains the signal, once each (JN-01).

    Archive ids, dates and serials are looked up in the text without blanks, dots and hyphens; parcels
    and title words in the lower-case text.
    """
    index = _signal_index(signals)
    key = F.col("signal_key")
    return _matches(chunks, index, _by_key(index), True).select(*CHUNK, F.explode("_s.k").alias("signal_key")).select(
        *CHUNK, F.substring_index(key, ":", 1).alias("signal_type"), F.expr("substr(signal_key, instr(signal_key, ':') + 1)").alias("normalized_value"), "signal_key"
    ).withColumn("weight", _by_type(1, F.col("signal_type")).cast("int"))


def score_chunks(chunks: DataFrame, signals: DataFrame, reasons: bool = True) -> DataFrame:
    """Score and, if wanted, sorted reasons of every chunk, zero included (AGG-01)."""
    index = _signal_index(signals)
    hits = _matches(chunks, index, _by_key(index), reasons).withColumnRenamed("score", "_score")
    light = chunks.select(*CHUNK, "chunk_id", "page", F.length("text").alias("text_length"))
    listed = [F.coalesce(F.transform("_s", lambda s: s["k"]), F.array().cast("array<string>")).alias("reasons")] if reasons else []
    return light.join(hits, list(CHUNK), "left").select(*light.columns, F.coalesce("_score", F.lit(0)).alias("score"), *listed)


def select_candidates(
    scored: DataFrame,
    *,
    context_window: int = fixed.CONTEXT_WINDOW,
    minimum: int = fixed.MIN_SCORE,
    max_chunks: int = fixed.MAX_CANDIDATE_CHUNKS,
    max_chars: int = fixed.MAX_CANDIDATE_CHARS,
) -> DataFrame:
    """Selection flags of every chunk (GEN-08, WIN-01 to WIN-04).

    Hits pull in their neighbours; the best `max_chunks` by score (lower index first) stay, in index
    order until the characters run out. Only numbers travel here, no text.
    """
    c = scored.select(*CHUNK, "chunk_id", "page", "text_length", "score")
    hits = c.where(F.col("score") >= minimum)
    spread = hits.select(
        *DOC, F.col("chunk_index").alias("_hit"), F.col("page").alias("_page"),
        F.explode(F.sequence(F.greatest(F.col("chunk_index") - context_window, F.lit(0)), F.col("chunk_index") + context_window)).alias("chunk_index"),
    )
    sources = spread.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct("_hit", "_page"))).alias("context_sources"))
    context = c.join(sources, list(CHUNK))
    ranked = position(
        context, list(DOC), {"s": -F.col("score"), "i": F.floor(F.col("chunk_index") / 4096)}, ["chunk_index"], "rank"
    )
    top = ranked.where(F.col("rank") <= max_chunks)
    taken = F.sum("text_length").over(
        Window.partitionBy(*DOC).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    )
    top = top.withColumn("_taken", taken).select(*CHUNK, "_taken")
    flags = ranked.join(top, list(CHUNK), "left").select(
        *CHUNK, "rank", "context_sources",
        F.coalesce(F.col("_taken") <= max_chars, F.lit(False)).alias("selected"),
        F.col("_taken").isNull().alias("candidate_cap_excluded"),
        F.coalesce(F.col("_taken") > max_chars, F.lit(False)).alias("char_cap_excluded"),
    )
    no = F.lit(False)
    return c.join(flags, list(CHUNK), "left").select(
        *c.columns, "rank", "context_sources",
        (F.col("score") >= minimum).alias("hit"),
        *[F.coalesce(x, no).alias(x) for x in ("selected", "candidate_cap_excluded", "char_cap_excluded")],
    )


def score_and_select(chunks: DataFrame, records: DataFrame, **limits: int) -> DataFrame:
    """Scores and selection flags of every chunk; the light score table, without reasons, is written once and read several times."""
    return select_candidates(materialize(score_chunks(chunks, record_signals(records), reasons=False)), **limits)


def selection_state() -> Column:
    """Six-way state of a chunk (FLT-19)."""
    return (
        F.when(F.col("selected") & F.col("hit"), "selected_hit").when(F.col("selected"), "selected_context")
        .when(F.col("char_cap_excluded"), "excluded_char_cap").when(F.col("candidate_cap_excluded"), "excluded_candidate_cap")
        .when(F.col("score") > 0, "below_threshold").otherwise("hidden")
    )


def selection_trace(selected: DataFrame) -> DataFrame:
    """Visible chunks with state, label and reason (SET-05)."""
    state = F.col("selection_state")
    label, reason = F.lit(None).cast("string"), F.lit("")
    for k, v in fixed.SELECTION_LABELS.items():
        label = F.when(state == k, v).otherwise(label)
    for k, v in fixed.SELECTION_REASONS.items():
        reason = F.when(state == k, v).otherwise(reason)
    others = F.filter("context_sources", lambda x: x["_hit"] != F.col("chunk_index"))
    sides = F.array_join(F.transform(others, lambda x: F.concat(F.lit("side "), x["_page"].cast("string"))), ", ")
    neighbour = F.when(
        F.coalesce(sides, F.lit("")) != "", F.concat(F.lit(fixed.SELECTION_NEIGHBOUR_PREFIX), sides, F.lit("."))
    ).otherwise(fixed.SELECTION_NEIGHBOUR_NONE)
    reason = F.when(state == "selected_context", neighbour).otherwise(reason)
    visible = (F.col("score") > 0) | F.col("selected") | F.col("candidate_cap_excluded") | F.col("char_cap_excluded")
    return selected.where(visible).withColumn("selection_state", selection_state()).select(
        *CHUNK, "chunk_id", "page", "score", "rank", "text_length", "selected", "selection_state",
        label.alias("selection_label"), reason.alias("selection_reason"),
    )


def selection_summary(selected: DataFrame, documents: DataFrame) -> DataFrame:
    """Counters per deed (AGG-06)."""
    deeds = documents.where(F.col("document_type") == fixed.DEED_TYPE).select(*DOC, "filename")
    s, hit, score = F.col("selected"), F.col("hit"), F.col("score")
    shown = (score > 0) | s | F.col("candidate_cap_excluded") | F.col("char_cap_excluded")
    counts = selected.groupBy(*DOC).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(s).alias("candidate_count"),
        F.coalesce(F.sum(F.when(s, F.col("text_length"))), F.lit(0)).alias("candidate_chars"),
        F.max("score").alias("max_score"),
        F.count_if(hit).alias("hit_chunks"),
        F.count_if(s & hit).alias("selected_hit_chunks"),
        F.count_if(s & ~hit).alias("selected_context_chunks"),
        F.count_if((score > 0) & ~hit & ~s).alias("below_threshold_chunks"),
        F.count_if(F.col("candidate_cap_excluded")).alias("candidate_cap_excluded_chunks"),
        F.count_if(F.col("char_cap_excluded")).alias("char_cap_excluded_chunks"),
        F.count_if(shown).alias("visible_chunks"),
    )
    return counts.join(deeds, list(DOC)).withColumn("skipped", F.col("candidate_count") == 0)


def scoring_totals(summary: DataFrame) -> DataFrame:
    """Totals over documents (AGG-07)."""
    return summary.groupBy("case_id").agg(
        F.count_if(~F.col("skipped")).alias("sent_documents"),
        F.count_if("skipped").alias("skipped_documents"),
        F.sum("candidate_count").alias("candidates"),
        F.sum("candidate_chars").alias("candidate_chars"),
        F.sum("selected_context_chunks").alias("context_chunks"),
    )


def _head(label: Column, w: Column, shown: Column) -> Column:
    return F.concat(label, F.lit(" ("), w.cast("string"), F.lit("): "), shown)


def _key_parts() -> tuple[Column, Column]:
    """Type and value of a signal key."""
    return F.substring_index("signal_key", ":", 1), F.expr("substr(signal_key, instr(signal_key, ':') + 1)")


def _told(signals: DataFrame, catalog: DataFrame, refs: int) -> DataFrame:
    """case_id, signal_key and the text of each signal, made once and not for every chunk that has it."""
    dash = F.lit(fixed.EMPTY_CELL)
    ref = signals.select(
        "case_id", "signal_key", "ord",
        F.concat(F.coalesce("date_reference", dash), F.lit(" — "), F.coalesce("title", dash)).alias("_ref"),
    )
    # the same summary counts once, at its first record
    once = ref.groupBy("case_id", "signal_key", "_ref").agg(F.min("ord").alias("ord"))
    first = first_per_key(once, ["case_id", "signal_key"], ["ord", "_ref"], refs)
    lists = first.groupBy("case_id", "signal_key").agg(F.array_sort(F.collect_list(F.struct("ord", "_ref"))).alias("_refs"))
    suffix = F.when(F.size("_refs") > 0, F.concat(F.lit(" → "), F.array_join(F.transform("_refs", lambda r: r["_ref"]), "; "))).otherwise("")
    known = catalog.select("case_id", "signal_key", "label", F.col("weight").alias("_w"), F.nullif(F.array_join("display_values", ", "), F.lit("")).alias("_shown"))
    kind, value = _key_parts()
    return known.join(lists, ["case_id", "signal_key"], "full").select(
        "case_id", "signal_key", F.concat(_head(F.coalesce("label", kind), F.coalesce("_w", F.lit(0)), F.coalesce("_shown", value)), suffix).alias("_x")
    )


def _as_told(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Rows with signal_key, and order, value and text of their signal as o, k and x; without catalogue entry its own key, weight 0."""
    kind, value = _key_parts()
    return rows.join(told, ["case_id", "signal_key"], "left").withColumns(
        {"o": _type_order(kind), "k": value, "x": F.coalesce("_x", _head(kind, F.lit(0), value))}
    ).drop("_x")


def signal_provenance(matches: DataFrame, signals: DataFrame, catalog: DataFrame, refs: int = 2) -> DataFrame:
    """Given matches of each chunk as one text with the first records behind them (JN-14, AGG-27).

    A reason without catalogue entry falls back to its own key, weight 0.
    """
    # a match travels with its key alone, then once with its text; all of a chunk then are in one place, and none is sorted before
    rows = _as_told(matches.select(*CHUNK, "signal_key"), _told(signals, catalog, refs)).select(*CHUNK, F.struct("o", "k", "x").alias("_s"))
    return rows.repartition(*CHUNK).groupBy(*CHUNK).agg(F.array_sort(F.collect_list("_s")).alias("_l")).select(
        *CHUNK, F.array_join(F.transform("_l", lambda s: s["x"]), " | ").alias("matched_signals")
    )


def chunk_provenance(chunks: DataFrame, signals: DataFrame, catalog: DataFrame, refs: int = 2) -> DataFrame:
    """The same for the signals that the chunks contain; their texts are sent once to a group of chunks, and no match is shuffled."""
    index = _signal_index(signals)
    return _matches(chunks, index, _as_told(index, _told(signals, catalog, refs)), True).select(
        *CHUNK, F.array_join(F.transform("_s", lambda s: s["x"]), " | ").alias("matched_signals")
    )
