"""Pieces that the operators of this subpackage share: shared storage, ordered buckets, hashed words, bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BASE, BASE2, BLOCK, SPACES, Chunk, chunks, gram_hashes, mixed, powers, run_hashes, spans, word_hashes  # noqa: F401
from ..storage import n_partitions, remove_path, shared_dir, size_in_bytes, stored  # noqa: F401


def whole_text_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows and 4 MB at most: workers hold whole texts, a batch at a time.

    Frames are lazy and Spark reads the two settings when they run, so the session keeps them; lower ones stay.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(str(spark.conf.get(name)).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names of its own; other columns can't clash."""
    whole_text_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, for a column in passing."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key():
    """What tells rows of one doc_id apart where ids repeat."""
    return F.xxhash64("text").alias("text_key")


# -- ordered buckets ------------------------------------------------------------------------------------------------


def id_splits(df: DataFrame, buckets: int, col: str = "doc_id") -> list[int]:
    """Up to buckets - 1 ascending ids that cut the ids into ranges of about equal size; bounded by buckets, not by rows."""
    if buckets < 2:
        return []
    got = df.approxQuantile(col, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    return sorted({int(x) for x in got})


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


#: A key with over 1 / HOT of the rows is a hot one; there are fewer than HOT of them.
HOT = 10_000


def meet(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with keys, which has each of its keys once and tells in `n` how many rows that has.

    Hot keys are broadcast to the rows, so none of their rows is shuffled; the other rows meet their keys by a shuffle.
    Both frames are read several times: they should lie in storage.
    """
    least = (keys.agg(F.sum(n)).first()[0] or 0) / HOT
    hot, others = keys.filter(F.col(n) > least).drop(n), keys.filter(F.col(n) <= least).drop(n)
    near = rows.join(F.broadcast(hot), on)  # fewer than HOT rows
    far = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(others.hint("merge"), on)
    return near.unionByName(far)


# -- bitmaps of a fixed size ----------------------------------------------------------------------------------------


def bitmap_of(hashes: DataFrame, col: str, bits: int) -> np.ndarray:
    """2**bits bits, set where the top bits of a 64-bit hash column point; what comes to the driver is 2**bits / 8 bytes at most.

    A sieve only: it never turns away a hash that is there, and what passes is joined exactly afterwards.
    """
    word = F.shiftrightunsigned(F.col(col), 64 - bits + 6)
    bit = F.shiftrightunsigned(F.col(col), 64 - bits).bitwiseAND(F.lit(63)).cast("int")
    got = hashes.select(word.cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap)).bit_length() - 1 + 6
    at = hashes >> np.uint64(64 - bits)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
