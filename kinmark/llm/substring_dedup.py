"""Substring dedup: Rabin-Karp hashes of stretches and of some windows of words, counted in Spark, merged into intervals.

Runs of half a window get a rolling hash each and are its anchors; stretches are counted before windows, and windows only
where stretches can overlap in part. A window of `window` consecutive words is a repeat if the same words also start in a
document with a smaller id; the words under repeats go. Four steps:

1. Sieve. Inside each window, the smallest hash of its runs of (window + 1) // 2 words is its anchor, which equal
   windows share. Anchors are about one word in thirteen; those found in one document only can't hold a repeat.
   The others set bits in a bitmap of fixed size, which is all that is broadcast.
2. Stretches. The windows of a document that have one anchor make up a stretch of text. Stretches are counted by a
   128-bit hash: the smallest id for each, combined before the shuffle. A stretch that is whole in a smaller id is all
   repeats, so groups of copies of any size cost a row a stretch.
3. Windows. Where an anchor has several stretches, these may overlap in part. For the first document of each of them
   (a second bitmap), every window's hash and its anchor are counted likewise. A window's smallest id is that of the
   first of the stretches that hold it, so no repeat is lost.
4. Merge. The repeats of a document join into maximal intervals, which are cut from the whole text.

A full bitmap lets everything through, which costs shuffle but changes no result. It grows with the input's size up to
2**MOST_BITS bits, or is as large as `sieve_bits` says.

Nulls: a null text has no words; a null id is unordered, so its text is returned whole and takes nothing from others.
Empty texts and texts shorter than a window lose nothing. Rows that repeat an id are each judged against smaller ids
only. An empty table gives an empty table. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
#: The sieves have 2**20 to 2**MOST_BITS bits: at most 32 MB each in a worker.
MOST_BITS = 28


def fitting_bits(n_bytes: int) -> int:
    """Sieve bits for an input of that size: about one for each two bytes, which is over twenty for an anchor."""
    return min(MOST_BITS, max(20, (n_bytes // 2).bit_length()))


def _anchors(words: np.ndarray, room: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, the place of each one's anchor, and the hashes of all runs that can be anchors."""
    run = (window + 1) // 2
    grams = C.gram_hashes(words, run)
    first = np.flatnonzero(room >= window)
    if not len(first):
        return first, first, grams
    width, at = window - run + 1, np.empty(len(first), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    for lo in range(0, len(first), C.BLOCK):
        part = first[lo : lo + C.BLOCK]
        at[lo : lo + C.BLOCK] = part + (views[part[0] : part[-1] + 1].argmin(1)[part - part[0]])
    return first, at, grams


def _firsts_hash(c1: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return C.mixed(c1.view(np.uint64) ^ C.mixed(ids.view(np.uint64)))


def repeated_windows(docs: DataFrame, window: int = WINDOW, sieve_bits: int | None = None) -> DataFrame:
    """(doc_id, text_key, runs): for each text, runs (start, n) of n windows in a row that start in a smaller id too."""
    spread = docs.sparkSession.sparkContext.broadcast
    sieve_bits = sieve_bits or fitting_bits(C.size_in_bytes(docs))

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for c in C.chunks(batch.column("text").to_pylist()):
                _, at, grams = _anchors(c.hashes(), c.room(), window)
                at = np.unique(at)
                yield pa.RecordBatch.from_arrays([C.signed(grams[at]), pa.array(ids[np.asarray(c.rows)][c.owner()[at]])], ["anchor", "doc_id"])

    own = docs.filter("doc_id is not null")
    anchors = own.mapInArrow(anchor_rows, "anchor long, doc_id long")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    sieve = spread(C.bitmap_of(shared, "anchor", sieve_bits))

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Of each chunk: its words, and its stretches' anchors, hashes, rows of the batch, first windows and numbers of windows."""
        for c in C.chunks(batch.column("text").to_pylist()):
            words = c.hashes()
            first, at, grams = _anchors(words, c.room(), window)
            if not len(first):
                continue
            new = np.ones(len(first), bool)
            new[1:] = (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(first)))
            lo, anchor = first[begin], grams[at[begin]]
            live = C.in_bitmap(sieve.value, anchor)
            lo, n, anchor = lo[live], n[live], anchor[live]
            if len(lo):
                one, two = (C.run_hashes(words, lo, lo + n + window - 1, base, 3) for base in (C.BASE, C.BASE2))
                yield c, words, anchor, one, two, np.asarray(c.rows)[c.owner()[lo]], lo, n

    def stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "text_key"))
            for c, _, anchor, one, two, row, lo, n in stretches(batch):
                start = (lo - c.first[c.owner()[lo]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([C.signed(anchor), C.signed(one), C.signed(two), pa.array(ids[row]), pa.array(keys[row]), pa.array(start), pa.array(n.astype(np.int32))], ["anchor", "c1", "c2", "doc_id", "text_key", "start", "n"])

    keyed = own.select("doc_id", "text", C.row_key())
    rows = C.stored(keyed.mapInArrow(stretch_rows, "anchor long, c1 long, c2 long, doc_id long, text_key long, start int, n int"))
    least = C.stored(rows.groupBy("anchor", "c1", "c2").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")))
    whole = C.meet(rows, least.filter("held > 1"), ["anchor", "c1", "c2"], "held").filter("least < doc_id").select("doc_id", "text_key", "start", "n")
    several = least.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    firsts = least.join(several, "anchor").select("c1", "least")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([C.signed(_firsts_hash(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))))], ["h"])

    torn = spread(C.bitmap_of(firsts.mapInArrow(hashed, "h long"), "h", sieve_bits))

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "text_key"))
            for c, words, anchor, one, _, row, lo, n in stretches(batch):
                live = C.in_bitmap(torn.value, _firsts_hash(one, ids[row]))
                lo, n, row, anchor = lo[live], n[live], row[live], anchor[live]
                if len(lo):
                    each = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    start = (each - c.first[c.owner()[each]]).astype(np.int32)
                    h, row = C.run_hashes(words, each, each + window, C.BASE2, 0), np.repeat(row, n)
                    yield pa.RecordBatch.from_arrays([C.signed(h), C.signed(np.repeat(anchor, n)), pa.array(ids[row]), pa.array(keys[row]), pa.array(start)], ["h", "anchor", "doc_id", "text_key", "start"])

    parts = C.stored(keyed.mapInArrow(window_rows, "h long, anchor long, doc_id long, text_key long, start int"))
    earliest = C.stored(parts.groupBy("h", "anchor").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")).filter("held > 1"))
    part = C.meet(parts, earliest, ["h", "anchor"], "held").filter("least < doc_id").select("doc_id", "text_key", "start", F.lit(1).alias("n"))
    return whole.unionByName(part).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def intervals(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words that runs (start, n) of windows cover."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(runs):
        end = start + n - 1 + window
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, sieve_bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text, kept_sha256): each text without the words of repeated windows.

    removed holds the intervals [from, to) of words that were cut. Only texts that may have a repeat are shuffled, to
    meet their windows; a bitmap of their ids, fixed at 1 MB, parts them off, and the join that follows is exact.
    """
    docs = C.id_text(df, id_col, text_col).select("doc_id", "text", C.row_key())
    repeats = C.stored(repeated_windows(docs, window, sieve_bits))
    hit = docs.sparkSession.sparkContext.broadcast(C.bitmap_of(repeats.select(F.xxhash64("doc_id").alias("h")), "h", 23))

    def sifted(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
                yield batch.filter(pa.array(C.in_bitmap(hit.value, h) == wanted))

        return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(run, "doc_id long, text string, text_key long, h long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = intervals([(r["start"], r["n"]) for r in runs[i] or []], window)
                kept, at = [], 0
                for lo, hi in gone:
                    kept += words[at:lo]
                    at = hi
                kept = b" ".join(kept + words[at:])
                rows.append((len(words), sum(hi - lo for lo, hi in gone), [[lo, hi] for lo, hi in gone], kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            n, r, g, t, sha = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(g, pa.list_(pa.list_(pa.int32()))), pa.array(t, pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256"])

    whole = sifted(False).select("doc_id", "text", F.lit(None).cast("array<struct<start:int,n:int>>").alias("runs"))
    touched = sifted(True).join(repeats, ["doc_id", "text_key"], "left").select("doc_id", "text", "runs")
    schema = "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept_text string, kept_sha256 string"
    return whole.mapInArrow(cut, schema).unionByName(touched.mapInArrow(cut, schema))
