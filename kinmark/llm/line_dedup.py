"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least `min_chars` code points
count. Documents come in batches of descending ids. For each batch:

1. its keys are counted (documents, largest id), combined before the shuffle;
2. they merge-join the sorted runs: keys that no run holds (the anti-join) enter with their largest id, which no later
   batch can raise; keys that a run does hold add to the count only;
3. the batch becomes a run of level 0; `fanout` runs of a level are merged into one of the next.

Runs are tables of the same number of buckets, sorted by key hash within each, so neither the joins nor the merges
shuffle a run again. In the end all runs are merged; a key found in at least `min_docs` documents loses its lines except
in the document with the largest id. Of these keys, those that have over 1 / HOT of all their rows, fewer than HOT, are
broadcast to the rows; the others meet theirs by a shuffle, none with more than that share in one task.

Null and empty texts have one empty line. Documents are told by id: rows that repeat one count once, and all rows with the
largest id keep the line. Rows with a null id are left as they are and don't count. An empty table stays empty. Extra
columns are dropped by line_dedup() and kept by without_lines(), which replaces those that have the names it gives.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
#: Documents of a batch at most; keys with over 1 / HOT of the rows of all repeated keys are fewer than HOT.
BATCH_DOCS, HOT = 50_000_000, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(key: Column) -> Column:
    """128 bits of a key's MD5."""
    return F.unhex(F.md5(key.cast("binary")))


class Runs:
    """Runs (key, n, last) by level: n documents so far, last the largest id, null where an older run has it."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, max(2, fanout)
        self.root, self.name = C.shared_dir(spark), f"kinmark_run_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        self.written += 1
        name = f"{self.name}_{self.written}"
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.root}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            C.remove_path(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merge(self, names: list[str], level: int) -> None:
        """Merges runs two by two into one of `level`; both sides lie in the same buckets, so nothing is shuffled."""
        while names:
            a, b = (self.spark.table(n).select("key", F.col("n").alias(f"n_{i}"), F.col("last").alias(f"last_{i}")) for i, n in enumerate(names[:2]))
            both = a.hint("merge").join(b, "key", "full")
            n = F.coalesce("n_0", F.lit(0)) + F.coalesce("n_1", F.lit(0))
            self._write(both.select("key", n.cast("long").alias("n"), F.greatest("last_0", "last_1").alias("last")), level)
            self._drop(names[:2])
            names = [self.levels[level].pop(), *names[2:]] if names[2:] else []

    def merged(self) -> DataFrame:
        """(key, n, last) over all runs, which become one."""
        names = self.names()
        if len(names) > 1:
            self.levels = [[] for _ in self.levels]
            self._merge(names, len(self.levels) - 1)
        return self.spark.table(self.names()[0])

    def add(self, batch: DataFrame) -> None:
        """batch: (key, doc_id), once for each document that holds the key; ids below those of earlier batches."""
        run = batch.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        for i, name in enumerate(self.names()):  # both sides lie in the same buckets
            held = self.spark.table(name).select("key", F.lit(True).alias(f"held{i}"))
            run = run.join(held.hint("merge"), "key", "left")
        held = [F.col(f"held{i}") for i in range(len(self.names()))]
        last = F.when(F.coalesce(*held).isNull(), F.col("last")) if held else F.col("last")
        self._write(run.select("key", "n", last.alias("last")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            level += 1
            self.levels += [[]] * (level == len(self.levels))
            self._merge(old, level)

    def close(self) -> None:
        self._drop(self.names())
        C.remove_path(self.spark, self.root)


def batch_count(n_docs: int) -> int:
    """Batches for a corpus: BATCHES at least, more from some ten million documents a batch on."""
    return max(BATCHES, -(-n_docs // BATCH_DOCS))


def repeated_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, gone): for each id that loses lines, the hashes of their keys; written to shared storage."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null")
    splits = C.id_splits(docs, batches or batch_count(docs.count()))
    batch = F.lit(0)
    for s in splits:
        batch = batch + (F.col("doc_id") < s).cast("int")
    long_keys = F.transform(F.filter(lines(F.col("text")), lambda x: F.length(x) >= min_chars), key)
    long_keys = F.filter(long_keys, lambda k: F.length(k) >= min_chars)
    keys = docs.select("doc_id", batch.alias("batch"), F.explode(F.array_distinct(F.transform(long_keys, hashed))).alias("key"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        keys = keys.dropDuplicates(["doc_id", "batch", "key"])
    root = C.shared_dir(spark)
    keys.write.partitionBy("batch").parquet(root)
    keys = spark.read.schema("doc_id long, key binary, batch int").parquet(root)
    runs = Runs(spark, C.n_partitions(df), fanout)
    for i in range(len(splits) + 1):
        runs.add(keys.filter(F.col("batch") == i).select("key", "doc_id"))
    often = C.stored(runs.merged().filter(F.col("n") >= min_docs))
    runs.close()
    least = (often.agg(F.sum("n")).first()[0] or 0) / HOT
    gone = [keys.join(side.select("key", "last"), "key") for side in (F.broadcast(often.filter(F.col("n") > least)), often.filter(F.col("n") <= least).hint("merge"))]
    out = C.stored(gone[0].unionByName(gone[1]).filter("doc_id < last").groupBy("doc_id").agg(F.collect_set("key").alias("gone")))
    C.remove_path(spark, root)
    return out


def without_lines(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, out_col: str = "kept_text", n_col: str = "n_lines", dropped_col: str = "n_dropped", hashes: str = "gone") -> DataFrame:
    """df, all its columns, with the text that is left and the numbers of lines before and dropped."""
    own_id, own_gone, may, n, kept = (C.unused(df, x) for x in ("id", "gone", "may", "lines", "kept"))
    # texts that lose nothing needn't meet the hashes: a bitmap of ids, fixed at 1 MB, parts them off; the join is exact
    sieve = df.sparkSession.sparkContext.broadcast(C.bitmap_of(gone.select(F.xxhash64("doc_id").alias("h")), "h", 23))
    passes = F.pandas_udf(lambda h: pd.Series(C.in_bitmap(sieve.value, h.to_numpy().view("uint64"))), "boolean")
    sifted = df.withColumn(may, passes(F.xxhash64(F.col(f"`{id_col}`").cast("long"))))
    # the hashes grow with the input, so neither side is broadcast, at any size
    got = gone.select(F.col("doc_id").alias(own_id), F.col(hashes).alias(own_gone)).hint("merge")
    touched = sifted.filter(F.col(may)).join(got, F.col(f"`{id_col}`") == F.col(own_id), "left")
    both = sifted.filter(~F.col(may)).withColumns({own_id: F.lit(None).cast("long"), own_gone: F.lit(None).cast("array<binary>")}).unionByName(touched)
    whole = lines(F.col(f"`{text_col}`"))
    left = F.when(F.col(own_gone).isNull(), whole).otherwise(F.filter(whole, lambda x: ~F.array_contains(F.col(own_gone), hashed(key(x)))))
    both = both.withColumns({n: F.size(whole).cast("long"), kept: left})
    return both.withColumns({out_col: F.array_join(kept, "\n"), n_col: F.col(n), dropped_col: F.col(n) - F.size(kept)}).drop(own_id, own_gone, may, n, kept)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every row."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    gone = repeated_lines(docs, "doc_id", "text", min_chars, min_docs, batches, fanout)
    return without_lines(docs, gone, "doc_id", "text").select("doc_id", "n_lines", "n_dropped", "kept_text")
