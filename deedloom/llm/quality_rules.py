"""Quality rules: compression bands beside plain counts of words, symbols, lines and repeats.

A text that compresses far better than prose repeats itself; one that hardly compresses is noise. The zstandard
ratio of the whole document must stay inside limits that depend on the length, because short texts compress less; so
must its chunks, of which the last one is the last `CHUNK_BYTES` bytes, so that no tail is left out. All work is inside
the row, so there is no shuffle and nothing to skew.

The limits lie outside the ratios of texts labelled good in sf0.1: the lowest less 15 % (25 % below 512 bytes, where
samples are few), the highest and about 4 %. What compresses like these passes: base64 below 112 bytes and hex digits
between 192 bytes and 3 KB cannot be told by ratio. Other corpora may need other limits.

Edge cases: a null or empty text has no words, fails the base rule and has ratio null; texts of any length are
read whole (chunks are slices of the same bytes); repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from deedloom.llm.common import BLANKS, columns, map_rows

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# bytes at least, lowest and highest ratio of compressed to plain bytes; below the first length nothing is said
WHOLE_LIMITS = (
    (64, 0.65, 1.17), (96, 0.60, 1.12), (112, 0.56, 0.96), (160, 0.50, 0.86), (192, 0.47, 0.86), (256, 0.45, 0.77), (384, 0.43, 0.735), (512, 0.44, 0.71),
    (768, 0.43, 0.65), (1024, 0.41, 0.605), (1536, 0.395, 0.565), (2048, 0.39, 0.54), (3072, 0.38, 0.515), (4096, 0.37, 0.495), (6144, 0.36, 0.48),
    (8192, 0.35, 0.47), (16384, 0.34, 0.45),
)
CHUNK_BYTES = 4096
CHUNK_LIMITS = (0.37, 0.51)
# a larger share of chunks outside their limits rejects the document
BAD_CHUNKS = 0.2
LEVEL = 3

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunks long, bad_chunks long"
)


def repeat_words(words: list) -> int:
    """Words inside 5-word windows that occur at least twice in the text, the first one included."""
    grams = list(zip(*[words[i:] for i in range(WINDOW)]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered = end = 0
    for at, g in enumerate(grams):
        if counts[g] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def limits(n: int) -> tuple[float, float]:
    """Lowest and highest allowed ratio of a document of n bytes."""
    low, high = 0.0, float("inf")
    for least, lo, hi in WHOLE_LIMITS:
        if n >= least:
            low, high = lo, hi
    return low, high


def bands(text: str | None, compress) -> tuple[float | None, int, int]:
    """Ratio of the whole text, number of chunks, number of chunks outside their limits."""
    raw = (text or "").encode()
    if not raw:
        return None, 0, 0
    ratio = len(compress(raw)) / len(raw)
    view, starts = memoryview(raw), list(range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES))
    if starts and len(raw) % CHUNK_BYTES:
        starts.append(len(raw) - CHUNK_BYTES)
    low, high = CHUNK_LIMITS
    bad = sum(not low <= len(compress(view[i : i + CHUNK_BYTES])) / CHUNK_BYTES <= high for i in starts)
    return ratio, len(starts), bad


def _make():
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def step(part: dict) -> list:
        rows = []
        for doc_id, text in zip(part["doc_id"], part["text"]):
            n, chars, symbols, dup, rep = base_counts(text)
            failed = n < 10 or 100 * rep > 20 * n
            ratio, chunks, bad = bands(text, compress)
            low, high = limits(len(text.encode()) if text else 0)
            inside = ratio is not None and low <= ratio <= high and bad <= BAD_CHUNKS * chunks
            rows.append((doc_id, n, chars, symbols, dup, rep, failed, inside and not failed, ratio, chunks, bad))
        return [list(c) for c in zip(*rows)]

    return step


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, the ratios and the verdict."""
    return map_rows(columns(docs, ("doc_id", "long"), ("text", "string")), _make, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns (a narrow pass, no join)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        step = _make()
        return pd.Series(step({"doc_id": [None] * len(texts), "text": list(texts)})[7] if len(texts) else [], dtype=bool)

    return docs.where(kept(F.col("text")))
