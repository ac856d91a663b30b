"""Order-dependent clustering of records.

Both rules read records in list order and compare each with the clusters so far. Small scopes of the
merge are folded in a task each, by lookups. A larger scope falls into parts that share no date, archive
id or title, so that no cluster can reach from one into another; bins of small parts are folded like
small scopes. What remains, a part that is large itself, is worked out in rounds: every round derives
all cluster states from the current assignment at once, with grouping and equality joins, and reassigns
every record; the first wrong record in order is right after each round, so the assignment settles, and a
settled one is exactly the sequential result. Rounds are spared where a fold of the few records that change a
cluster's state settles a part (`_sieved`). No case is gathered in one task. Rounds hold keys and
numbers only and are written out, so lineage stays short and lost executors do no harm.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from deedloom import fixed
from deedloom.functions import dates as D, text as T
from deedloom.operators.groups import connected
from deedloom.operators.positions import position
from deedloom.session import materialize

# records of a scope that one task may fold
FOLD_ROWS = 20_000
COMPLETE = ("beneficiary", "summary", "disposition_type", "legal_type", "action_note")


def star_groups(records: DataFrame) -> DataFrame:
    """(case_id, ord, centre): greedy star clustering on serial and full date (first half of AGG-20).

    In list order a record that is still free becomes a centre and takes every free record it matches:
    equal serials when both have one, else equal full dates. Consequences that make rounds possible:
    the dated records without serial of one date are taken together; a serial has at most one centre,
    its first record that no centre of its date took before. So only the first record of each serial
    and date pair and of each bare date matters.
    """
    c = D.date_components("date_reference")
    base = materialize(
        records.select("case_id", "ord", c.alias("_c")).select(
            "case_id", "ord", F.col("_c.lob_suffix").alias("s"), F.col("_c.full_date").alias("t")
        )
    )
    pairs = base.where("s is not null").groupBy("case_id", "s", "t").agg(F.min("ord").alias("i"))
    dates = base.where("s is null and t is not null").groupBy("case_id", "t").agg(F.min("ord").alias("d"))
    pairs = materialize(pairs.join(dates, ["case_id", "t"], "left"))
    state = materialize(dates.withColumn("own", F.lit(None).cast("boolean")))  # own: the bare date has its own centre

    def marked(state: DataFrame) -> tuple[DataFrame, DataFrame]:
        p = pairs.join(state.select("case_id", "t", "own"), ["case_id", "t"], "left")
        late = F.col("d").isNotNull() & (F.col("d") < F.col("i"))
        p = p.withColumns({"open": ~late | (F.col("own") == F.lit(False)), "unsure": late & F.col("own").isNull()})
        serials = p.groupBy("case_id", "s").agg(
            F.min(F.when(F.coalesce("open", F.lit(False)), F.col("i"))).alias("o"),
            F.min(F.when(F.col("unsure"), F.col("i"))).alias("u"),
        )
        return p, serials

    while True:
        p, serials = marked(state)
        early = p.where(F.col("i") < F.col("d")).join(serials, ["case_id", "s"])
        is_first = F.col("o") == F.col("i")
        sure = F.col("u").isNull() | (F.col("u") > F.col("i"))
        votes = early.groupBy("case_id", "t").agg(
            F.bool_or(is_first & sure).alias("taken"), F.bool_or(is_first & ~sure).alias("open_vote")
        )
        no = F.lit(False)
        nxt = state.join(votes, ["case_id", "t"], "left").select(
            "case_id", "t", "d",
            F.when(F.col("own").isNotNull(), F.col("own"))
            .when(F.coalesce("taken", no), no)
            .when(F.coalesce("open_vote", no), F.lit(None).cast("boolean"))
            .otherwise(F.lit(True)).alias("own"),
        )
        state = materialize(nxt)
        if state.where("own is null").isEmpty():
            break

    p, serials = marked(state)
    centres = serials.select("case_id", "s", F.col("o").alias("cs"))
    at_date = (
        p.join(centres, ["case_id", "s"]).where("i = cs").groupBy("case_id", "t").agg(F.min("cs").alias("g"))
    )
    joined = (
        base.join(state, ["case_id", "t"], "left").join(centres, ["case_id", "s"], "left").join(at_date, ["case_id", "t"], "left")
    )
    by_date = F.col("own") & (F.col("d") < F.col("ord")) & (F.col("cs").isNull() | (F.col("cs") > F.col("d")))
    centre = (
        F.when(F.col("s").isNotNull(), F.when(F.coalesce(by_date, F.lit(False)), F.col("d")).otherwise(F.col("cs")))
        .when(F.col("t").isNotNull(), F.when(F.col("own"), F.col("d")).otherwise(F.col("g")))
        .otherwise(F.col("ord"))
    )
    return joined.select("case_id", "ord", centre.alias("centre"))


def dedup_deeds(records: DataFrame) -> DataFrame:
    """One record per star: most complete, then most confident, then first (AGG-20).

    `centre` orders the result as the sequential pass would.
    """
    filled = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in COMPLETE), F.lit(0))
    # written once: what makes the records would run again for the stars, the choice and the result
    records = materialize(records.withColumn("_filled", filled))
    groups = star_groups(records)
    light = records.select("case_id", "ord", "_filled", "confidence").join(groups, ["case_id", "ord"])
    best = light.groupBy("case_id", "centre").agg(
        F.max(F.struct("_filled", "confidence", (-F.col("ord")).alias("_neg"))).alias("_b"), F.count(F.lit(1)).alias("group_size")
    )
    chosen = best.select("case_id", (-F.col("_b._neg")).alias("ord"), "centre", "group_size")
    return records.drop("_filled").join(chosen, ["case_id", "ord"])


def _assign(items: DataFrame, pages: DataFrame, current: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One round: the cluster each record joins, given the clusters of the current assignment."""
    members = items.join(current, [*scope, "ord"])
    founders = members.where("founder = ord")
    # date: one cluster per date reference
    by_date = founders.where("dk is not null").groupBy(*scope, "dk").agg(F.min("ord").alias("f_date"))
    # archive id: a cluster keeps the first one it meets; among clusters that have it the earliest wins
    acquired = members.where("ak is not null").groupBy(*scope, "founder").agg(
        F.min(F.struct("ord", "ak")).alias("m")
    ).select(*scope, "founder", F.col("m.ak").alias("ak"), F.col("m.ord").alias("at"))
    earlier = Window.partitionBy(*scope, "ak").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stairs = acquired.withColumn("low", F.min("founder").over(earlier)).where("low is null or founder < low").drop("low")
    by_akt = (
        items.where("ak is not null").select(*scope, "ord", "ak").join(stairs, [*scope, "ak"]).where("at < ord")
        .groupBy(*scope, "ord").agg(F.min("founder").alias("f_akt"))
    )
    dated = items.join(by_date, [*scope, "dk"], "left").join(by_akt, [*scope, "ord"], "left")
    dated = dated.withColumn("f_date", F.when(F.col("f_date") < F.col("ord"), F.col("f_date")))
    # title: the longest so far, first of its length, in the founder's document, on near pages
    lengths = members.groupBy(*scope, "founder", "tlen").agg(F.min(F.struct("ord", "tk")).alias("m"))
    lengths = lengths.select(*scope, "founder", "tlen", F.col("m.ord").alias("from"), F.col("m.tk").alias("tk"))
    w = Window.partitionBy(*scope, "founder").orderBy("from")
    longer = lengths.withColumn("seen", F.max("tlen").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    titles = (
        longer.where("seen is null or tlen > seen").withColumn("to", F.lead("from").over(w)).where("tk is not null")
        .join(founders.select(*scope, "founder", "doc"), [*scope, "founder"]).select(*scope, "founder", "doc", "tk", "from", "to")
    )
    first_on = (
        pages.join(current, [*scope, "ord"]).groupBy(*scope, "founder", "page").agg(F.min("ord").alias("p_from"))
    )
    wp = Window.partitionBy(*scope, "founder").orderBy("p_from", "page")
    lows = (
        first_on.withColumn("low", F.min("page").over(wp.rowsBetween(Window.unboundedPreceding, -1)))
        .where("low is null or page < low")
    )
    # several pages of one record share p_from; only its lowest stays the low of that moment
    lows = lows.groupBy(*scope, "founder", "p_from").agg(F.min("page").alias("page"))
    lows = lows.withColumn("p_to", F.lead("p_from").over(Window.partitionBy(*scope, "founder").orderBy("p_from")))
    open_items = dated.where("f_date is null and f_akt is null and tk is not null").select(*scope, "ord", "doc", "tk")
    asking = open_items.join(pages, [*scope, "ord"])
    seen_title = (F.col("from") < F.col("ord")) & (F.col("to").isNull() | (F.col("ord") <= F.col("to")))
    on_page = titles.join(first_on, [*scope, "founder"])
    same = asking.join(on_page, [*scope, "doc", "tk", "page"]).where(seen_title & (F.col("p_from") < F.col("ord")))
    lowest = asking.groupBy(*scope, "ord", "doc", "tk").agg(F.min("page").alias("lo"))
    reach = fixed.SEGMENT_OVERLAP_PAGES
    around = lowest.withColumn("page", F.explode(F.sequence(F.col("lo") - reach, F.col("lo") + reach)))
    near = around.join(titles.join(lows, [*scope, "founder"]), [*scope, "doc", "tk", "page"]).where(
        seen_title & (F.col("p_from") < F.col("ord")) & (F.col("p_to").isNull() | (F.col("ord") <= F.col("p_to")))
    )
    by_title = (
        same.select(*scope, "ord", "founder").unionByName(near.select(*scope, "ord", "founder"))
        .groupBy(*scope, "ord").agg(F.min("founder").alias("f_title"))
    )
    return dated.join(by_title, [*scope, "ord"], "left").select(
        *scope, "ord", F.coalesce("f_date", "f_akt", "f_title", "ord").alias("founder")
    )


def _fold(rows: pd.DataFrame, scope: Sequence[str]) -> pd.DataFrame:
    """Founders of one small scope in list order. Clusters are looked up by date, archive id and title, never scanned."""
    by_date: dict[str, int] = {}
    by_akt: dict[str, int] = {}
    by_title: dict[tuple[str, str], list[int]] = {}
    state: dict[int, list] = {}  # founder -> archive id, title key, title length, document, pages
    found = []
    rows = rows.sort_values("ord")
    for n, dk, ak, tk, tlen, doc, pages in rows[["ord", "dk", "ak", "tk", "tlen", "doc", "pages"]].itertuples(index=False):
        own = set() if pages is None else set(pages)
        home = by_date.get(dk)
        if home is None:
            home = by_akt.get(ak)
        if home is None and tk and own:
            for f in by_title.get((doc, tk), ()):
                theirs = state[f][4]
                if theirs and (theirs & own or abs(min(theirs) - min(own)) <= fixed.SEGMENT_OVERLAP_PAGES):
                    home = f
                    break
        if home is None:
            home = n
            state[n] = [None, None, -1, doc, set()]
            if dk:
                by_date.setdefault(dk, n)
        cluster = state[home]
        if cluster[0] is None and ak:
            cluster[0] = ak
            by_akt[ak] = min(home, by_akt.get(ak, home))
        if tlen > cluster[2]:
            if cluster[1]:
                by_title[(cluster[3], cluster[1])].remove(home)
            cluster[1], cluster[2] = tk, tlen
            if tk:
                insort(by_title.setdefault((cluster[3], tk), []), home)
        cluster[4] |= own
        found.append(home)
    return rows[[*scope, "ord"]].assign(founder=found)


def merge_groups(records: DataFrame, pages: DataFrame, scope: Sequence[str], small: int = FOLD_ROWS) -> DataFrame:
    """(scope, ord, founder): the cluster every record ends in (first half of AGG-21).

    In list order a record joins the cluster with its date reference, else the first one holding its
    archive id, else the first one with its current title in the same document on near pages; else it
    founds a cluster. `pages` lists the evidence pages: scope, ord, page.

    Scopes of at most `small` records are folded in one task each. Larger ones are never gathered: their
    connected parts of at most `small` records are folded in bins, the parts beyond that are worked out in
    rounds. The result is the same on each way.
    """
    title = T.strip(F.coalesce("title", F.lit("")))
    items = materialize(
        records.select(
            *scope, "ord", T.merge_key("date_reference").alias("dk"), T.merge_key("akt_nr").alias("ak"),
            T.merge_key("title").alias("tk"), F.length(title).alias("tlen"), F.col("source_document").alias("doc"),
        )
    )
    pages = materialize(pages.select(*scope, "ord", "page").distinct())
    large = materialize(items.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).drop("n"))
    listed = pages.where("page is not null").groupBy(*scope, "ord").agg(F.collect_list("page").alias("pages"))
    few = items.join(large, list(scope), "left_anti").join(listed, [*scope, "ord"], "left")
    folded = _folded(few, scope, records.schema)
    if large.isEmpty():
        return materialize(folded)
    rest = items.join(large, list(scope), "left_semi")
    # a cluster can hold the title of a record from another document than its founder's, so titles bind across documents
    parted = materialize(rest.join(connected(rest, scope, [F.col("dk"), F.col("ak"), F.col("tk")]), [*scope, "ord"]))
    sizes = materialize(parted.groupBy(*scope, "part").agg(F.count(F.lit(1)).alias("n")))
    # a bin holds half of `small` on average, so that one of several parts seldom holds more than `small`
    bins = sizes.where(F.col("n") <= small)
    per_scope = bins.groupBy(*scope).agg(F.greatest(F.lit(1), F.ceil(2 * F.sum("n") / F.lit(max(small, 1)))).alias("bins"))
    bins = bins.join(per_scope, list(scope)).select(*scope, "part", F.pmod(F.xxhash64("part"), "bins").alias("bin"))
    binned = parted.join(bins, [*scope, "part"]).drop("part").join(listed, [*scope, "ord"], "left")
    folded = materialize(folded.unionByName(_folded(binned, [*scope, "bin"], binned.schema).drop("bin")))
    huge = sizes.where(F.col("n") > small).drop("n")
    if huge.isEmpty():
        return folded
    inner = [*scope, "part"]
    wide = materialize(parted.join(huge, inner, "left_semi"))
    wide_pages = materialize(pages.join(wide.select(*inner, "ord"), [*scope, "ord"]))
    wide_listed = listed.join(wide.select(*inner, "ord"), [*scope, "ord"])
    return folded.unionByName(_in_rounds(wide, wide_pages, wide_listed, inner, small).drop("part"))


def _folded(rows: DataFrame, scope: Sequence[str], schema: StructType) -> DataFrame:
    """Founders by one task for each value of the scope."""
    kinds = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in scope)
    return rows.groupBy(*scope).applyInPandas(partial(_fold, scope=list(scope)), f"{kinds}, ord long, founder long")


def _moves(items: DataFrame, pages: DataFrame, current: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, ord): records at which the state of a cluster changes under an assignment.

    They found it, bring its archive id, a longer title or a page it had not. All other members leave it as it was.
    """
    cluster = [*scope, "founder"]
    members = materialize(items.join(current, [*scope, "ord"]).select(*cluster, "ord", "ak", "tlen"))
    firsts = members.groupBy(*cluster).agg(
        F.min("ord").alias("a"), F.min(F.when(F.col("ak").isNotNull(), F.col("ord"))).alias("b")
    ).select(*scope, F.explode(F.array("a", "b", "founder")).alias("ord"))
    lengths = members.groupBy(*cluster, "tlen").agg(F.min("ord").alias("ord"))
    seen = F.max("tlen").over(Window.partitionBy(*cluster).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    longer = lengths.withColumn("seen", seen).where("seen is null or tlen > seen")
    on_page = pages.join(current, [*scope, "ord"]).groupBy(*cluster, "page").agg(F.min("ord").alias("ord"))
    every = firsts.where("ord is not null").unionByName(longer.select(*scope, "ord")).unionByName(on_page.select(*scope, "ord"))
    return materialize(every.distinct())


def _sieved(items: DataFrame, pages: DataFrame, listed: DataFrame, current: DataFrame, scope: Sequence[str], small: int) -> tuple[DataFrame, DataFrame]:
    """An assignment of all records made from a fold of few, and the scopes where it is the sequential result.

    Most records leave their cluster as it was, so the clusters' states follow from a fold of those that do not; the
    others are looked up in these states at once. Which records those are is guessed from an assignment: whatever moves a state under
    the assignment found and was not folded joins the folded ones, until there is none. The states are then those of
    all records, so the assignment is settled and exact. A scope that would need more than `small` of its records folded is handed back.
    """
    key = [*scope, "ord"]
    pairs = items.where("dk is not null or ak is not null").groupBy(*scope, "dk", "ak").agg(F.min("ord").alias("ord"))
    chosen = materialize(_moves(items, pages, current, scope).unionByName(pairs.select(*key)).distinct())
    done: list[DataFrame] = []
    settled: list[DataFrame] = []
    while True:
        wide = materialize(chosen.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).drop("n"))
        fit = chosen.join(wide, list(scope), "left_anti")
        mine = materialize(fit.select(*scope).distinct())
        if not wide.isEmpty():
            items, pages = (materialize(x.join(mine, list(scope), "left_semi")) for x in (items, pages))
        folded = materialize(_folded(items.join(fit, key, "left_semi").join(listed, key, "left"), scope, items.schema))
        done.append(current.join(wide, list(scope), "left_semi"))
        current = materialize(_assign(items, pages, folded, scope))
        new = materialize(_moves(items, pages, current, scope).join(fit, key, "left_anti"))
        left = materialize(new.select(*scope).distinct())
        right = materialize(mine.join(left, list(scope), "left_anti"))
        settled.append(right)
        done.append(current.join(right, list(scope), "left_semi"))
        if left.isEmpty():
            return materialize(reduce(DataFrame.unionByName, done)), materialize(reduce(DataFrame.unionByName, settled))
        chosen = materialize(fit.join(left, list(scope), "left_semi").unionByName(new))
        items, pages = (materialize(x.join(left, list(scope), "left_semi")) for x in (items, pages))
        current = current.join(left, list(scope), "left_semi")


def _in_rounds(items: DataFrame, pages: DataFrame, listed: DataFrame, scope: Sequence[str], small: int) -> DataFrame:
    """Founders of large parts: from a fold of the records that move a state, else all cluster states from the assignment
    and all records reassigned, until nothing moves."""
    first = lambda k: items.where(f"{k} is not null").groupBy(*scope, k).agg(F.min("ord").alias(f"first_{k}"))
    guess = items.join(first("dk"), [*scope, "dk"], "left").join(first("ak"), [*scope, "ak"], "left").select(
        *scope, "ord", F.coalesce(F.least("first_dk", "first_ak"), "ord").alias("founder")
    )
    current, exact = _sieved(items, pages, listed, materialize(guess), scope, small)
    settled = [current.join(exact, list(scope), "left_semi")]
    current = current.join(exact, list(scope), "left_anti")
    if current.isEmpty():
        return settled[0]
    active_items, active_pages = items.join(exact, list(scope), "left_anti"), pages.join(exact, list(scope), "left_anti")
    # scopes do not touch each other: one that a round left unchanged is done, only the others go on
    while True:
        nxt = materialize(_assign(active_items, active_pages, current, scope))
        both = nxt.join(current.withColumnRenamed("founder", "before"), [*scope, "ord"])
        moving = materialize(both.where("founder <> before").select(*scope).distinct())
        settled.append(nxt.join(moving, list(scope), "left_anti"))
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        current = nxt.join(moving, list(scope), "left_semi")
        active_items = items.join(moving, list(scope), "left_semi")
        active_pages = pages.join(moving, list(scope), "left_semi")


def merge_register(records: DataFrame, evidence: DataFrame, scope: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merged register records with their new priority, and their evidence rows (AGG-21, AGG-22, WIN-06).

    `evidence` has scope, ord, pos, chunk_id, document_id, page, text_excerpt. A record seen once keeps
    its lists as they are; merged lists keep first-seen order without repeats.
    """
    keys = [*scope, "founder"]
    groups = merge_groups(records, evidence, scope)
    m = records.join(groups, [*scope, "ord"])
    text = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.col("ord"), F.col(c).alias("v"))))
    longest = lambda c: F.max(F.struct(F.length(text(c)).alias("n"), (-F.col("ord")).alias("neg"), F.col(c).alias("v")))
    merged = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct("ord", "date_reference", "source_document", "scope_source")).alias("_f"),
        first("registered_at").alias("_reg"), first("akt_nr").alias("_akt"),
        longest("title").alias("_title"), longest("raw_scope_text").alias("_scope"),
        F.max("confidence").alias("confidence"),
    )
    own = lambda c: F.when(-F.col(f"{c}.neg") == F.col("founder"), F.col(f"{c}.v")).otherwise(T.strip(F.col(f"{c}.v")))
    merged = merged.select(
        *keys, "members", "confidence", "_f.date_reference", "_f.source_document",
        F.when(F.col("members") > 1, F.lit("attest")).otherwise(F.coalesce("_f.scope_source", F.lit("attest"))).alias("scope_source"),
        F.col("_reg.v").alias("registered_at"), F.col("_akt.v").alias("akt_nr"),
        own("_title").alias("title"), own("_scope").alias("raw_scope_text"),
    )
    for c in [c for c in ("applies_to_matrikler", "raw_matrikel_references") if c in records.columns]:
        values = m.select(*keys, "ord", F.posexplode(c).alias("pos", "v"))
        once = values.where("v <> ''").groupBy(*keys, "v").agg(F.min(F.struct("ord", "pos")).alias("o"))
        unique = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("_l"))
        raw = m.where("ord = founder").select(*keys, F.col(c).alias("_raw"))
        listed = F.coalesce(F.transform("_l", lambda x: x["v"]), F.array().cast("array<string>"))
        merged = merged.join(unique, keys, "left").join(raw, keys).withColumn(
            c, F.when(F.col("members") == 1, F.col("_raw")).otherwise(listed)
        ).drop("_l", "_raw")
    ev = evidence.join(groups, [*scope, "ord"])
    once = ev.groupBy(*keys, "document_id", "page", "text_excerpt").agg(F.min(F.struct("ord", "pos", "chunk_id")).alias("o"))
    kept = once.select(*keys, "document_id", "page", "text_excerpt", F.col("o.chunk_id").alias("chunk_id"), F.col("o.ord").alias("ord"), F.col("o.pos").alias("pos"))
    low = ev.groupBy(*keys).agg(F.min("page").alias("first_page"))
    merged = merged.join(low, keys, "left")
    by_page = F.coalesce(F.col("first_page").cast("long"), F.lit(10**9))
    by_date = F.coalesce(F.col("registered_at").cast("string"), F.lit(""))
    ref, name = F.coalesce("date_reference", F.lit("")), F.coalesce("title", F.lit(""))
    placed = position(merged, list(scope), {"p": by_page, "d": by_date}, [ref, name, F.col("founder")], "_nr")
    return placed.withColumn("priority", F.col("_nr") - 1).drop("_nr"), kept

