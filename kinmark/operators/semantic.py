"""Dense vectors: normalisation, clipped cosine and exact top-k search of a query set in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors of a block and rows of a chunk at most; with 1024 numbers each, 8 MB and 16 MB.
BLOCK, CHUNK = 1024, 2048


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Over the Euclidean norm, which counts as 1e-10 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-10))
    return F.transform(doubles(v), lambda x: x / norm)


def clipped_cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors, kept within 0 and 1."""
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, v) in chunks of up to CHUNK of them, a chunk a row."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            held.append(batch.slice(lo, min(CHUNK, batch.num_rows - lo)))
            n += held[-1].num_rows
            if n >= CHUNK:
                yield _chunk(held)
                held, n = [], 0
    if n:
        yield _chunk(held)


def _chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    ids, v = (np.concatenate([np.asarray(x) for x in part]) for part in zip(*[(b.column("vec_id"), b.column("v").flatten()) for b in held], strict=True))
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([v], pa.list_(pa.float64()))], ["ids", "m"])


def _normal(ids: pa.Scalar, m: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids, m = np.asarray(ids.values), np.asarray(m.values)
    m = m.reshape(len(ids), -1)
    return ids, m / np.maximum(np.sqrt((m * m).sum(1)), 1e-10)[:, None]


def cosine_topk(vectors: DataFrame, k: int = 5, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, rank, similarity): for each id divisible by `every`, the k most similar other rows of all.

    Queries lie in blocks of about BLOCK, all rows in chunks of up to CHUNK, each a row of a table; every chunk meets every
    block as one product of matrices, which passes on k rows a query. Nothing comes to the driver. Similarity is rounded to
    6 digits before ranking, ties go to the smaller id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), doubles(F.col(vec_col)).alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    queries = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    # a chunk is made again for each partition of blocks, so these hold a good many
    dealt = dealt.select(F.col("q.vec_id").alias("q_ids"), F.flatten("q.v").alias("q")).repartition(-(-blocks // 32))
    chunks = rows.mapInArrow(_packed, "ids array<bigint>, m array<double>")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, m = _normal(batch.column("ids")[i], batch.column("m")[i])
                q_ids, q = _normal(batch.column("q_ids")[i], batch.column("q")[i])
                s = np.floor(np.clip(q @ m.T, 0, 1) * 1e6 + 0.5) / 1e6
                s[q_ids[:, None] == names[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(names, s.shape), -s), axis=1)[:, :k]
                best = np.take_along_axis(s, order, 1)
                good = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q_ids[:, None], good.shape)[good]), pa.array(names[order][good]), pa.array(best[good])], ["query_id", "vec_id", "similarity"])

    # the stated queries against all rows, in blocks: a few rows on either side, no pair of single rows
    found = chunks.crossJoin(dealt).mapInArrow(search, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "similarity")
