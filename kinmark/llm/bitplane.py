"""Token ids as binary blocks of bit or byte planes, with a chunk index.

Layout of a written folder: Parquet, split in two by `kind`, both written by one job.

- kind=block: one row per block of `block_ids` ids (fewer in the last of a part): part, block, first_id (ids before it
  in its part), n_ids, width (bytes an id), plane sizes (the chunk index: where each compressed plane begins in data)
  and data. Planes hold byte j (or bit j) of every id, little end first, each compressed with zstandard.
- kind=segment: one row per document and block that it touches: doc_id, at (ids of the part before the document),
  n_tokens (whole document), offset (of the segment in its document), length, and where it lies: part, block, first.

Parts are ranges of ascending ids; a part's first id in the whole sequence is the sum of those before it. Parquet gives
committed, retried and remote writes on any store that Spark writes to. Reading needs no order among blocks: a block
decodes alone, and a document that spans blocks is put together from its segments.

Null texts are empty: they hold only the end id. Null ids come first; rows that repeat an id follow each other by their
token ids. An empty table gives empty folders of the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .pieces import LibraryEncoder, slices

BLOCK_IDS = 1 << 15
SCHEMA = "kind string, part int, block int, first_id long, n_ids int, width int, sizes array<int>, data binary, doc_id long, at long, n_tokens long, offset long, length int, first int"


def to_planes(ids: np.ndarray, plane: str = "byte") -> list[bytes]:
    """Byte or bit planes of an array of unsigned ids."""
    cells = ids.astype(ids.dtype.newbyteorder("<")).view(np.uint8).reshape(len(ids), -1)
    if plane == "byte":
        return [cells[:, j].tobytes() for j in range(cells.shape[1])]
    bits = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(bits[:, j]).tobytes() for j in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The ids again; eight times as many planes as bytes in an id mean bit planes."""
    if len(planes) == width:
        cells = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        cells = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(cells).view(f"<u{width}").reshape(n)


def pack(ids: np.ndarray, plane: str = "byte", level: int = 3) -> tuple[list[int], bytes]:
    squeeze = zstandard.ZstdCompressor(level=level)
    parts = [squeeze.compress(p) for p in to_planes(ids, plane)]
    return [len(p) for p in parts], b"".join(parts)


def unpack(sizes: list[int], data: bytes, n: int, width: int) -> np.ndarray:
    expand, ends = zstandard.ZstdDecompressor(), np.cumsum(sizes).tolist()
    return from_planes([expand.decompress(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)], n, width)


def write_ids(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = BLOCK_IDS, plane: str = "byte") -> None:
    """Encode every whole text, append end_id, and write the ids to `path` in ascending id order."""
    docs = C.id_text(df, id_col, text_col).withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    splits = C.id_splits(docs, C.n_partitions(docs), "order")
    cuts = np.array(splits, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = LibraryEncoder.of(tokenizer)
        tail = np.array([end_id], encoder.dtype).tobytes()
        for batch in slices(batches):
            ids = encoder.encode(batch.column("text"), tail)
            part = np.searchsorted(cuts, batch.column("order").to_numpy(), "right").astype(np.int32)
            width = np.full(len(part), encoder.dtype.itemsize, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("order"), batch.column("doc_id"), ids, pa.array(width)], ["part", "order", "doc_id", "ids", "width"])

    rows = docs.mapInArrow(encode, "part int, order long, doc_id long, ids binary, width int")
    rows = rows.repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("part", "order", "ids")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block, part, width, total = [], 0, 0, 0, 2, 0
        out: list[dict] = []

        def flush() -> None:
            nonlocal held, size, block
            ids = np.frombuffer(b"".join(held), f"<u{width}")
            sizes, data = pack(ids, plane)
            out.append({"kind": "block", "part": part, "block": block, "first_id": block * block_ids, "n_ids": len(ids), "width": width, "sizes": sizes, "data": data})
            held, size, block = [], 0, block + 1

        for batch in batches:
            for part, doc_id, ids, width in zip(*(batch.column(x).to_pylist() for x in ("part", "doc_id", "ids", "width")), strict=True):  # noqa: B007
                n, done = len(ids) // width, 0
                while done < n:
                    take = min(n - done, block_ids - size)
                    out.append({"kind": "segment", "part": part, "block": block, "doc_id": doc_id, "at": total, "n_tokens": n, "offset": done, "length": take, "first": size})
                    held.append(ids[done * width : (done + take) * width])
                    size, done = size + take, done + take
                    if size == block_ids:
                        flush()
                total += n
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        if size:
            flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))
    rows.mapInArrow(blocks, SCHEMA).write.partitionBy("kind").parquet(path)


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).filter(F.col("kind") == kind)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, at, part, n_tokens, offset, length, ids): segments decoded from blocks, ids as little-endian uint32."""
    blocks = _read(spark, path, "block").select("part", "block", "n_ids", "width", "sizes", "data")
    lying = F.collect_list(F.struct("doc_id", "at", "n_tokens", "offset", "length", "first")).alias("segments")
    index = _read(spark, path, "segment").groupBy("part", "block").agg(lying)  # at most block_ids of them a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = unpack(row["sizes"], row["data"], row["n_ids"], row["width"]).astype("<u4")
                out = [s | {"part": row["part"], "ids": ids[s["first"] : s["first"] + s["length"]].tobytes()} for s in row["segments"]]
                yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])
    return blocks.join(index, ["part", "block"]).mapInArrow(run, "doc_id long, at long, part int, n_tokens long, offset long, length int, ids binary")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written files."""
    segments = read_segments(spark, path)
    rest = F.when(F.col("length") < F.col("n_tokens"), F.col("ids"))  # of documents that lie in several blocks: about one a block
    pieces = segments.select("doc_id", "part", "at", "n_tokens", "offset", F.crc32("ids").alias("crc"), rest.alias("ids"))
    by_doc = pieces.groupBy("part", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "crc", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    crc = F.when(F.size("p") == 1, F.col("p")[0]["crc"]).otherwise(F.crc32(joined))
    # one row a part: as many as shuffle partitions
    ends = _read(spark, path, "segment").groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return by_doc.join(F.broadcast(ends), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
