"""URL filter: host and path rules first, a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, read whole URLs: everything after
the scheme, query and fragment included. Of the URLs that a rule decides, those whose hash begins with one of `HELD` are
held out, the others are counted. A prediction mixes the orders from long to short: P(c | ab) = (n(abc) + M P(c | b)) /
(n(ab) + M) and so on down to the uniform distribution. Characters are mapped to an alphabet of `A` symbols, so a
model is a table of A^3 cells whatever the input: that proven bound lets the log ratio of all cells, in
micro-nats, be a constant of the plan. Scoring is then a fold inside the row: no join, no shuffle, no Python.

The score is the log-likelihood difference over the number of symbols. Its threshold is calibrated on the held-out URLs.
Cells are worked out once and written.

Edge cases: a null url or one without "://" has an empty host and path, meets no rule and scores 0; with no
accepted or no rejected URL to learn from all scores are 0, and with none held out every URL is above the threshold; very long URLs are read whole;
repeated rows are judged alike and each counts in training; of rules of equal length the first listed wins; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from deedloom.llm.common import UPPER, columns
from deedloom.session import materialize

# action, host, path in the order of the contract
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
# symbol 0 is padding, 1 any other character, then one for digits, signs of URLs and letters
SIGNS = "/.-_?=&%:~+,;"
A = 3 + len(SIGNS) + 26
PRIOR = 2.0
SCALE = 1_000_000
STEP = 10_000
# first hex digits of the hashes of held-out URLs: five of sixteen
HELD = "01234"


def rule_name(host: str, path: str) -> str:
    return f"{host}{path}"


def after_scheme(url: Column) -> Column:
    """Everything after the first "://", empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def parts(rest: Column) -> tuple[Column, Column]:
    """Host and path of what follows the scheme."""
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds `rule` and `ruled` (its action): the longest rule that fits."""
    by_length = sorted(rules, key=lambda r: -len(rule_name(*r[1:])))
    name = action = F.lit(None).cast("string")
    for act, host, path in reversed(by_length):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, action = F.when(fits, F.lit(rule_name(host, path))).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return df.withColumns({"rule": name, "ruled": action})


def with_symbols(df: DataFrame) -> DataFrame:
    """Adds `syms`, the symbols of everything after the scheme (`rest`), led by two paddings."""
    letters = UPPER.lower()
    whole = F.translate("rest", UPPER, letters)
    # one printable stand-in per symbol: code point 48 + symbol
    known = "0123456789" + SIGNS + letters
    stand = [2] * 10 + [3 + i for i in range(len(SIGNS))] + [3 + len(SIGNS) + i for i in range(26)]
    other = F.regexp_replace(whole, r"(?s)[^0-9a-z/.\-_?=&%:~+,;]", "!")
    coded = F.translate(F.translate(other, known, "".join(chr(256 + s) for s in stand)), "!", chr(257))
    each = F.transform(F.filter(F.split(coded, ""), lambda c: c != ""), lambda c: F.ascii(c) - 256)
    return df.withColumn("syms", F.concat(F.array(F.lit(0), F.lit(0)), each))


def _cells(syms: Column) -> Column:
    """Cell number of every trigram that ends in a real symbol."""
    at = lambda i: F.element_at(syms, i.cast("int"))
    whole = F.transform(F.sequence(F.lit(3), F.size(syms)), lambda i: (at(i - 2) * A + at(i - 1)) * A + at(i))
    return F.when(F.size(syms) > 2, whole).otherwise(F.array().cast("array<int>"))


def train(judged: DataFrame) -> list[int]:
    """Log ratio accepted to rejected of each of the A^3 cells, in micro-nats; all 0 if a side has no URL."""
    spark = judged.sparkSession
    seen = judged.where("ruled is not null and not held").select("ruled", F.explode("cells").alias("cell"))
    side = lambda a: F.count(F.when(F.col("ruled") == a, 1)).cast("double")
    counts = seen.groupBy("cell").agg(side("allow").alias("g"), side("block").alias("b"))
    cells = spark.range(A**3).withColumnRenamed("id", "cell").join(F.broadcast(counts), "cell", "left").na.fill(0.0, ["g", "b"])
    cells = cells.selectExpr("cell", f"cell % {A} as c3", f"cell div {A} % {A} as c2", f"cell div {A * A} as c1", "g", "b")

    # counts of the shorter contexts: how often a symbol, and a symbol after one other, was predicted
    c2 = cells.groupBy("c2", "c3").agg(F.sum("g").alias("g2"), F.sum("b").alias("b2"))
    c1 = cells.groupBy("c3").agg(F.sum("g").alias("g1"), F.sum("b").alias("b1"))
    n3 = cells.groupBy("c1", "c2").agg(F.sum("g").alias("gn3"), F.sum("b").alias("bn3"))
    n2 = cells.groupBy("c2").agg(F.sum("g").alias("gn2"), F.sum("b").alias("bn2"))
    good, bad = cells.agg(F.sum("g"), F.sum("b")).first()
    full = cells.withColumns({"gn1": F.lit(good), "bn1": F.lit(bad)}).join(c1, "c3").join(n2, "c2").join(c2, ["c2", "c3"]).join(n3, ["c1", "c2"])

    def p(s: str) -> str:
        first = f"(({s}1 + {PRIOR}D / {A}) / ({s}n1 + {PRIOR}D))"
        second = f"(({s}2 + {PRIOR}D * {first}) / ({s}n2 + {PRIOR}D))"
        return f"(({s} + {PRIOR}D * {second}) / ({s}n3 + {PRIOR}D))"

    ratio = f"case when gn1 = 0 or bn1 = 0 then 0 else cast(round({SCALE} * (ln({p('g')}) - ln({p('b')}))) as int) end"
    # A^3 numbers: bounded by the alphabet, not by the input
    return [r[1] for r in sorted(full.selectExpr("cell", f"{ratio} as lr").collect())]


def with_score(df: DataFrame, ratios: list[int]) -> DataFrame:
    """Adds `score`, the mean log ratio per symbol in whole micro-nats; 0 for an empty URL."""
    # a foldable expression: the optimiser turns it into one constant array
    model = F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<int>")
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.get(model, c))
    return df.withColumn("score", F.when(F.size("cells") > 0, F.floor(total / F.size("cells")) / SCALE).otherwise(F.lit(0.0)))


def threshold(scored: DataFrame) -> float:
    """Least score that is allowed, calibrated on the held-out URLs that a rule decides.

    Of the steps between their scores the one with the largest sum of accepted share allowed and rejected share
    blocked; the threshold is the middle of the gap below it. The histogram has at most some thousand steps.
    """
    side = lambda a: F.count(F.when(F.col("ruled") == a, 1))
    steps = sorted(
        scored.where("ruled is not null and held").groupBy(F.floor(F.col("score") * SCALE / STEP).alias("step")).agg(side("allow"), side("block")).collect()
    )
    good, bad = sum(g for _, g, _ in steps), sum(b for _, _, b in steps)
    if not good or not bad:
        return float("-inf")
    best, at, lost, caught, before = -1, 0, 0, 0, None
    for step, g, b in steps:
        gain = (good - lost) * bad + caught * good
        if gain > best:
            best, at = gain, step if before is None else (before + 1 + step) // 2
        lost, caught, before = lost + g, caught + b, step
    return at * STEP / SCALE


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score."""
    given = columns(pages, ("page_id", "long"), ("url", "string"))
    cut = given.withColumn("rest", after_scheme(F.col("url")))
    host, path = parts(F.col("rest"))
    held = F.coalesce(F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD), F.lit(False))
    coded = with_symbols(with_rule(cut.withColumns({"host": host, "path": path, "held": held}), rules))
    coded = materialize(coded.withColumn("cells", _cells(F.col("syms"))).drop("syms", "url", "rest"))
    ratios = train(coded)
    scored = with_score(coded, ratios)
    least = threshold(scored)
    by_model = F.when(F.col("score") >= F.lit(least), F.lit("allow")).otherwise(F.lit("block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
