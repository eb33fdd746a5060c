"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A rolling hash over the last seven bytes ends a chunk wherever it is -1 modulo the block size, so chunk borders
follow the content: after an insertion they fall back into step. Each chunk gives a symbol of 12 bits, written as
two characters. The block size is the smallest of 3 * 2**k that gives at most 64 chunks (fewer bytes, smaller
blocks), and the signatures at it, at twice and at four times of it are kept: `size:first:second:third`.

Two fingerprints are compared at their smallest common block size: likeness is 1 - d / (m + n), where m and n are the
numbers of symbols and d the edit distance by insertions and deletions. Without a common size it is 0; equal
fingerprints have 1. Empty and null texts have the fingerprint `3:::`.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST, MOST, REACH, LEVELS = 3, 64, 7, 3
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIRS = [a + b for a in SYMBOLS for b in SYMBOLS]
_WEIGHTS = np.array([pow(0x01000193, i, 1 << 32) | 1 for i in range(1, REACH + 1)], np.uint32)


def _candidates(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ends of chunks at block size `size`: places, rolling hashes, prefix sums and inverse powers there; the whole sum."""
    places, rolls, sums, inverses, total = [], [], [], [], 0
    for lo in range(0, len(data), C.BLOCK):
        part = np.frombuffer(data[lo : lo + C.BLOCK], np.uint8)
        back = min(lo, REACH - 1)
        near = np.frombuffer(data[lo - back : lo + C.BLOCK], np.uint8).astype(np.uint32) + np.uint32(1)
        roll = near * _WEIGHTS[0]
        for i in range(1, min(REACH, len(near))):
            roll[i:] += near[:-i] * _WEIGHTS[i]
        roll = roll[back:]
        roll = (roll ^ (roll >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        roll ^= roll >> np.uint32(13)
        power, inverse = C.powers(C.BASE, len(part) + 1)
        shift, unshift = pow(C.BASE, lo, 1 << 64), pow(pow(C.BASE, -1, 1 << 64), lo, 1 << 64)
        run = np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)])
        at = np.flatnonzero(roll % np.uint32(size) == size - 1)
        places.append(at + lo + 1)
        rolls.append(roll[at])
        sums.append(run[at] * np.uint64(shift) + np.uint64(total))
        inverses.append(inverse[at + 1] * np.uint64(unshift))
        total = (total + int(run[-1]) * shift) % (1 << 64)
    if not places:
        z = np.zeros(0, np.uint64)
        return z.astype(np.int64), z.astype(np.uint32), z, z, 0
    return *(np.concatenate(x) for x in (places, rolls, sums, inverses)), total


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return f"{LEAST}" + ":" * LEVELS
    guess = LEAST
    while guess * MOST * 8 < len(data):
        guess *= 2
    place, roll, prefix, inverse, total = _candidates(data, guess)
    size = guess
    while size < len(data) and np.count_nonzero(roll % np.uint32(size) == size - 1) >= MOST:
        size *= 2
    parts = []
    for level in range(LEVELS):
        big = size << level
        at = np.flatnonzero(roll % np.uint32(big) == big - 1) if big < 1 << 32 else place[:0]
        ends, before = prefix[at], np.zeros(1, np.uint64)
        start = np.ones(1, np.uint64)
        if not len(at) or place[at[-1]] < len(data):
            ends = np.append(ends, np.uint64(total))
            before, start = np.append(before, prefix[at]), np.append(start, inverse[at])
        else:
            before, start = np.append(before, prefix[at[:-1]]), np.append(start, inverse[at[:-1]])
        symbols = C.mixed((ends - before) * start) >> np.uint64(52)
        parts.append("".join([PAIRS[i] for i in symbols.tolist()]))
    return ":".join([str(size), *parts])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence of symbols, in bits of one integer a row."""
    x, y = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (a, b))
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        if m := where.get(c):
            u = row & m
            row = (row + u | row - u) & full
    return len(x) - row.bit_count()


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (m, *x), (n, *y) = a.split(":"), b.split(":")
    x, y = ({int(k) << i: s for i, s in enumerate(v)} for k, v in ((m, x), (n, y)))
    size = min(x.keys() & y.keys(), default=0)
    if not size or not x[size] or not y[size]:
        return 0.0
    a, b = x[size], y[size]
    return 4 * _common(a, b) / (len(a) + len(b))


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each whole text; no shuffle. A column that has the name already is replaced."""
    f = F.pandas_udf(lambda s: s.map(lambda t: fingerprint(t)), "string")
    return df.withColumn(out_col, f(F.coalesce(df[f"`{text_col}`"], F.lit(""))))


def likeness_column(a, b):
    """Likeness of two fingerprint columns."""
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if i is None or j is None else likeness(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(f, "double")(a, b)


def with_next(df: DataFrame, id_col: str, text_col: str, visit, schema: str) -> DataFrame:
    """visit(id, text, next text) of every row, where next follows in ascending id order and the first follows the last.

    Rows go to ranges of ids once, their texts compressed; the first row of a range also goes to the range before it.
    Ids that repeat follow each other in the order of their compressed texts; null ids come first.
    """
    docs = C.id_text(df, id_col, text_col).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    n = C.n_partitions(docs)
    splits = C.id_splits(docs, n, "at")
    bucket = F.size(F.filter(F.array(*map(F.lit, splits)).cast("array<bigint>"), lambda s: s <= F.col("at")))
    starts = dict(docs.groupBy(bucket.alias("b")).agg(F.min("at")).collect())  # a row a range
    order = sorted(starts)
    before = {starts[b]: order[i - 1] for i, b in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            at = batch.column("at").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for x, i, t in zip(at, ids, batch.column("text").to_pylist(), strict=True):
                z = squeeze.compress(t.encode("utf-8", "surrogatepass"))
                rows.append((bisect_right(splits, x), 0, x, i, z))
                if x in before:
                    rows.append((before[x], 1, x, i, z))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=["b", "ahead", "at", "doc_id", "z"])

    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    dealt = docs.mapInArrow(deal, "b int, ahead int, at long, doc_id long, z binary")
    dealt = dealt.repartitionById(len(splits) + 1, F.col("b")).sortWithinPartitions("b", "ahead", "at", "z")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, held, out = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for b, ahead, i, z in zip(*(batch.column(x).to_pylist() for x in ("b", "ahead", "doc_id", "z")), strict=True):
                text = expand.decompress(z).decode("utf-8", "surrogatepass")
                if held and held[0] == b:
                    out.append(visit(held[1], held[2], text))
                held = None if ahead else (b, i, text)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return dealt.mapInArrow(walk, schema)


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text (second half from the next document), and their likeness."""
    last: list = [None, ""]

    def print_of(text: str) -> str:
        if last[0] != text:
            last[:] = [text, fingerprint(text)]
        return last[1]

    def visit(doc_id: int | None, text: str, following: str) -> dict:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed = print_of(text), fingerprint(edited)
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": own, "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, print_of(following)),
        }

    return with_next(df, id_col, text_col, visit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
