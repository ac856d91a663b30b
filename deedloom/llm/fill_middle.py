"""Fill-in-the-middle transformation by displacement scatter.

The UTF-8 bytes of a slice of documents lie in one array. The two cuts of a document are code points found among the
bytes that start a character. Prefix, middle and suffix each move by one distance, written into a difference array at
their ends; its cumulative sum is the shift of every byte, and one scatter builds all outputs of the slice. Restoring
reads nothing but outputs and forms: it scans for the three marks, writes the inverse distances in the same way and
gathers the text back.

Cuts and form come from a hash of seed and doc_id, so retried tasks and repeated rows give the same output. Slices
hold `SLICE` bytes, or one longer document, so memory follows the longest text and not the batch.

Edge cases: a null text is empty; empty texts and texts that hold a mark stay plain; a null doc_id hashes as the word
`null`; texts are cut whole whatever their length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deedloom.llm.common import columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
RATE, SPM_RATE = 90, 20
SLICE = 1 << 20
MARK = 3
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of a document's hash as integers."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def marks_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the marks in a byte array, and the letter of each."""
    if len(data) < MARK:
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    opening = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")))
    letter = data[opening + 1]
    known = (letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))
    return opening[known], letter[known]


def owners(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Document of each mark, -1 where it reaches over the document's end."""
    doc = np.searchsorted(bounds, at, "right") - 1
    return np.where(at + MARK <= bounds[doc + 1], doc, -1)


def shifts(size: int, starts: np.ndarray, ends: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Shift of every byte when the segments [start, end) move by the given distances."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, by)
    np.subtract.at(step, ends, by)
    return np.cumsum(step[:-1])


def scatter(data: np.ndarray, bounds: np.ndarray, ids: list, seed: int, rate: int, spm_rate: int) -> dict:
    """Outputs of a slice: bytes and bounds, with n, form and cut lengths of each document."""
    docs, size = len(ids), len(data)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, bounds)
    n = np.diff(first)
    h = np.array([draws(seed, i) for i in ids], np.int64).reshape(docs, 4)
    holds = np.zeros(docs, bool)
    own = owners(marks_at(data)[0], bounds)
    holds[own[own >= 0]] = True
    plain = (n == 0) | holds | (h[:, 2] % 100 >= rate)
    spm = ~plain & (h[:, 3] % 100 < spm_rate)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)

    place = np.append(chars, size)
    start, end = bounds[:-1], bounds[1:]
    cut1, cut2 = place[first[:-1] + low], place[first[:-1] + high]
    cut1, cut2 = np.where(low == n, end, cut1), np.where(high == n, end, cut2)
    lengths = end - start + np.where(plain, 0, 3 * MARK)
    out_bounds = np.concatenate(([0], np.cumsum(lengths)))
    to = out_bounds[:-1]
    p, s = cut1 - start, end - cut2
    # where each segment begins in the output
    at_p = to + np.where(plain, 0, np.where(spm, s + 2 * MARK, MARK))
    at_s = to + np.where(spm, MARK, p + 2 * MARK)
    at_m = to + p + s + 3 * MARK
    parts = [(start, cut1, at_p), (cut1, cut2, np.where(plain, to + p, at_m)), (cut2, end, np.where(plain, to + cut2 - start, at_s))]
    by = shifts(
        size, np.concatenate([x for x, _, _ in parts]), np.concatenate([y for _, y, _ in parts]), np.concatenate([z - x for x, _, z in parts])
    )
    out = np.empty(out_bounds[-1], np.uint8)
    out[np.arange(size) + by] = data
    cut = ~plain
    for name, place_of in ((PREFIX, at_p), (SUFFIX, at_s), (MIDDLE, at_m)):
        for k, byte in enumerate(name.encode()):
            out[place_of[cut] - MARK + k] = byte
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return {"out": out, "bounds": out_bounds, "n": n, "form": form, "plain": plain, "prefix": low, "middle": high - low}


def gather(out: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a slice, as bytes and bounds, from outputs and forms alone."""
    docs = len(form)
    cut = form != "plain"
    at, letter = marks_at(out)
    own = owners(at, bounds)
    where = {}
    for c in "PSM":
        where[c] = np.zeros(docs, np.int64)
        mine = (letter == ord(c)) & (own >= 0)
        where[c][own[mine]] = at[mine]
    start, end = bounds[:-1], bounds[1:]
    psm = form == "psm"
    text_bounds = np.concatenate(([0], np.cumsum(end - start - np.where(cut, 3 * MARK, 0))))
    to = text_bounds[:-1]
    from_p = np.where(cut, where["P"] + MARK, start)
    p = np.where(cut, np.where(psm, where["S"], where["M"]) - from_p, end - start)
    from_s = np.where(cut, where["S"] + MARK, end)
    s = np.where(cut, np.where(psm, where["M"], where["P"]) - from_s, 0)
    from_m = np.where(cut, where["M"] + MARK, end)
    m = end - from_m
    parts = [(to, p, from_p), (to + p, m, from_m), (to + p + m, s, from_s)]
    by = shifts(
        text_bounds[-1], np.concatenate([x for x, _, _ in parts]), np.concatenate([x + k for x, k, _ in parts]),
        np.concatenate([z - x for x, _, z in parts]),
    )
    return out[np.arange(text_bounds[-1]) + by], text_bounds


def _strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds of a string column; a null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts hold at most SLICE bytes together; a longer text is alone."""
    data, bounds = _bytes_of(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def _mapped(df: DataFrame, text: str, step: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in _slices(batch, text):
                yield pa.RecordBatch.from_arrays(step(part, data, bounds), names=fields.names)

    return df.mapInArrow(run, fields)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per document: doc_id, n (code points), form, prefix_chars, middle_chars (null if plain) and output.

    `rate` of 100 documents are cut, and of these `spm_rate` of 100 have the suffix first.
    """

    def step(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        r = scatter(data, bounds, part.column("doc_id").to_pylist(), seed, rate, spm_rate)
        return [
            part.column("doc_id"), pa.array(r["n"], pa.int64()), pa.array(r["form"].tolist(), pa.string()),
            pa.array(r["prefix"], pa.int64(), mask=r["plain"]), pa.array(r["middle"], pa.int64(), mask=r["plain"]), _strings(r["out"], r["bounds"]),
        ]

    return _mapped(columns(docs, ("doc_id", "long"), ("text", "string")), "text", step, OUT)


def restore(transformed: DataFrame) -> DataFrame:
    """The rows of `transform` with the column `restored`, the text rebuilt from `output` and `form`."""

    def step(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        form = np.array(part.column("form").to_pylist(), dtype="U5")
        return [*part.columns, _strings(*gather(data, bounds, form))]

    return _mapped(transformed, "output", step, f"{OUT}, restored string")


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Lengths, forms and SHA-256 of outputs and of texts rebuilt from them."""
    return restore(transform(docs, seed)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )
