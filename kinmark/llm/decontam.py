"""Benchmark decontamination by winnowing: least k-gram hashes of sliding windows, joined and extended to shared spans.

A window is `window` consecutive words of a benchmark item (an item of fewer words is one window). Its fingerprint is
the least hash of its k-grams, k = window // 2, so whenever a document holds a window, both sides have chosen the same
k-gram: every shared span of `window` words or more is found. Documents' fingerprints are joined with the benchmark's,
each meeting is extended to the whole window (checked by a 128-bit hash), and windows that overlap or touch make up
the full span. Items shorter than a window are looked up by their own length.

The benchmark comes in blocks of about `block_bytes` of text; items of over a quarter of that are cut into parts that
overlap by a window less a word, so no window is lost and no block is larger. A block's index (under 10 times its text) is
broadcast and the documents are read past it once, without a shuffle; a benchmark of one block, as usual, means one pass.
With more blocks, a document's findings in each are brought together by its id.

Words: A-Z lower-cased, then runs of letters a-z, digits and non-ASCII characters. Null and empty texts have no words:
such a document is clean, such an item is in no document. Repeated rows and ids are each judged alone; items that share
an id count once. An item without an id hits like others, but has no name to be listed or counted. Empty tables: no documents, or all of them clean. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Lower case for A-Z; what is neither letter, digit nor non-ASCII becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Index:
    """The windows of one block of the benchmark, by hash, with the items that have each."""

    def __init__(self, items: dict[str | None, list[str]], window: int):
        self.window, self.ids = window, sorted(items, key=lambda x: (x is None, x))  # no name comes last
        texts, codes = [], []
        for code, name in enumerate(self.ids):
            texts += items[name]
            codes += [code] * len(items[name])
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        prints = [np.zeros(0, np.uint64)]
        for c in C.chunks(texts, translate=FOLD):
            words, room, code = c.hashes(), c.room(), np.asarray(codes)[np.asarray(c.rows)][c.owner()]
            first, least = fingerprints(words, room, window)
            prints.append(np.unique(least))
            n = np.repeat(c.n_words, c.n_words)
            for size in {window, *np.unique(c.n_words[(c.n_words > 0) & (c.n_words < window)]).tolist()}:
                at = first if size == window else np.flatnonzero((n == size) & (room == size))
                if len(at):
                    one, two = hashes(words, size)
                    found.setdefault(size, []).append((one[at], two[at], code[at]))
        self.prints = np.unique(np.concatenate(prints))
        self.of = {}
        for size, parts in found.items():
            one, two, code = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = np.unique(np.rec.fromarrays([one, two, code], names="one,two,code"))
            new = np.ones(len(rows), bool)
            new[1:] = (rows.one[1:] != rows.one[:-1]) | (rows.two[1:] != rows.two[:-1])
            start = np.flatnonzero(new)
            self.of[size] = rows.one[start], rows.two[start], np.append(start, len(rows)), rows.code.copy()

    def hits(self, c: C.Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, first words, which windows) for each size of window that occurs in the chunk's texts."""
        words, room = c.hashes(), c.room()
        for size, (one, two, _, _) in self.of.items():
            if size == self.window:
                first, least = fingerprints(words, room, size)
                first = first[member(self.prints, least)[0]]
            else:
                first = np.flatnonzero(room >= size)
            if len(first):
                h1, h2 = hashes(words, size)
                yes, at = member(one, h1[first])
                yes &= two[at] == h2[first]
                if yes.any():
                    yield size, first[yes], at[yes]


def hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return C.gram_hashes(words, size), C.gram_hashes(words, size, C.BASE2, size)


def fingerprints(words: np.ndarray, room: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each whole window, and the least hash of its k-grams."""
    k = max(1, window // 2)
    grams, first = C.gram_hashes(words, k), np.flatnonzero(room >= window)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    m = len(words) - window + 1
    least = grams[:m].copy()
    for i in range(1, window - k + 1):
        np.minimum(least, grams[i : i + m], out=least)
    return first, least[first]


def member(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in an ordered array, and where."""
    if not len(ordered):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x, at


def _match(docs: DataFrame, index) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items) for one block of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            n = batch.num_rows
            n_words, covered, items = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for c in C.chunks(batch.column("text").to_pylist(), translate=FOLD):
                rows, owner, edge, pairs = np.asarray(c.rows), None, None, []
                n_words[rows] = c.n_words
                for size, first, at in ix.hits(c):
                    if owner is None:
                        owner, edge = c.owner(), np.zeros(len(c.starts) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + size, -1)
                    _, _, start, code = ix.of[size]
                    each = start[at + 1] - start[at]
                    which = np.repeat(start[at] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
                    pairs.append(np.unique(np.repeat(owner[first], each) * len(ix.ids) + code[which]))
                if owner is not None:
                    inside = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                    turn = np.flatnonzero(np.diff(inside.astype(np.int8)))
                    for lo, hi in turn.reshape(-1, 2).tolist():
                        while lo < hi:  # spans of neighbouring texts can touch
                            i = owner[lo]
                            end = min(hi, int(c.first[i + 1]))
                            covered[rows[i]].append([lo - int(c.first[i]), end - int(c.first[i])])
                            lo = end
                    for p in np.unique(np.concatenate(pairs)).tolist():
                        if (name := ix.ids[p % len(ix.ids)]) is not None:
                            items[rows[p // len(ix.ids)]].append(name)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words), pa.array(covered, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, "doc_id long, text_key long, n_words long, spans array<array<int>>, items array<string>")


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def parts_of(text: str, window: int, most: int) -> Iterator[str]:
    """A text of over `most` bytes in parts of about that many, which together have its windows of words and no others."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= most:
        yield text
        return
    data = data.translate(FOLD)
    separator = np.zeros(256, np.bool_)
    separator[32] = True
    starts, ends = C.spans(np.frombuffer(data, np.uint8), separator)
    i, n = 0, len(starts)
    if n < window:
        yield text
    while i + window <= n:
        j = max(i + window, int(np.searchsorted(ends, starts[i] + most, "right")))
        yield data[starts[i] : ends[j - 1]].decode("utf-8", "surrogatepass")
        i = n if j == n else j - window + 1


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) for every row of df."""
    spark = df.sparkSession
    docs = C.id_text(df, id_col, text_col).select("doc_id", "text", C.row_key())
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in parts_of(text, window, block_bytes // 4):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([part], pa.string())], ["item", "text"])

    size, longest = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes))
    if (longest or 0) > block_bytes // 4:
        items = items.mapInArrow(cut, "item string, text string")
    if blocks > 1:  # one look at the benchmark; each block is read alone
        path = C.shared_dir(spark)
        items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).write.partitionBy("block").parquet(path)
        items = spark.read.schema("item string, text string, block long").parquet(path)
    parts = []
    for i in range(blocks):
        held: dict[str | None, list[str]] = {}
        for row in (items.filter(F.col("block") == i) if blocks > 1 else items).toLocalIterator():
            held.setdefault(row["item"], []).append(row["text"])
        parts.append(_match(docs, spark.sparkContext.broadcast(Index(held, window))))
    if blocks > 1:
        C.remove_path(spark, path)
    if blocks == 1:
        found = parts[0].withColumns({"spans": F.array("spans"), "items": F.array("items"), "times": F.lit(1)})
    else:
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        found = every.groupBy("doc_id", "text_key").agg(F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"), (F.count("*") / blocks).cast("int").alias("times"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for doc, key, n, spans, names, times in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text_key", "n_words", "spans", "items", "times")), strict=True):
                spans, names = _joined([x for s in spans for x in s]), sorted({x for s in names for x in s})
                hit = sum(hi - lo for lo, hi in spans)
                row = (doc, key, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, spans, names)
                for _ in range(times):
                    for column, x in zip(columns, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=fields)

    fields = ["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]
    return found.mapInArrow(finish, "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>, items array<string>")
