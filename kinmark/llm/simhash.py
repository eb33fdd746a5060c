"""SimHash near-dedup: fingerprints, BK-trees over blocks of equal bits, and connected components in Spark.

Fingerprints within `radius` bits are linked; a class is what links reach. Steps:

1. Each text's 64-bit fingerprint: bit b is 1 if it is 1 in over half of its shingles' XXH64. Texts with one
   fingerprint are in one class from the start and go on as a single row (the smallest id), so groups of copies
   of any size cost one row.
2. The 64 bits are cut into `blocks` blocks; two fingerprints within the radius agree in blocks - radius of them at
   least. Each fingerprint goes to a bucket for each choice of that many blocks. More fingerprints get more blocks,
   so buckets stay small; the choice changes the cost only, never the links.
3. A bucket's fingerprints enter a BK-tree, whose children are keyed by integer Hamming distance to the parent; a
   search follows only edges within the radius, and skips subtrees whose nodes are in the searcher's class already.
   Each bucket gives a link for each merge of classes, not all its pairs. A bucket of over `max_tree` fingerprints
   is dealt to shard trees of at most about that size, and each pair of shards is a task of its own.
4. Links become classes by alternating large-star and small-star steps, each written to shared storage.

The trees are built where their bucket lies instead of being broadcast: fingerprints of all documents have no size
bound, and a bucket holds every fingerprint that its tree could link.

Null and empty texts have fingerprint zero and are linked like others. Rows that repeat an id share its class. Rows
with a null id get a fingerprint and a null class. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, RADIUS, SEED = 4, 4, 42
MAX_TREE = 20_000
#: Mean number of fingerprints in a bucket that the choice of blocks aims at.
BUCKET = 128


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """SimHash of a list of words; zero if there are none."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[lo : lo + (1 << 14)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of rows (doc_id, text); fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.encode("utf-8", "surrogatepass").lower().split(), shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), C.signed(np.array(fps, np.uint64))], ["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def choose_blocks(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks for which n fingerprints make buckets of BUCKET on average, or as near as 16 blocks come."""
    return next((b for b in range(radius + 1, 16) if n * 2.0 ** -(64 // b * (b - radius)) <= BUCKET), 16)


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - radius)]


class BKTree:
    """Fingerprints with their classes; add() links each newcomer to every class within the radius, once."""

    def __init__(self, radius: int):
        self.radius, self.value, self.children, self.parent, self.tag = radius, [], [], [], []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def near(self, value: int) -> list[int]:
        """One node of each class that has a node within the radius."""
        found: dict[int, int] = {}
        stack = [0] if self.value else []
        while stack:
            i = stack.pop()
            tag = self.tag[i]
            if found and tag >= 0 and self.find(tag) in found:
                continue
            d = (self.value[i] ^ value).bit_count()
            if d <= self.radius:
                found.setdefault(self.find(i), i)
            stack += [c for k, c in self.children[i].items() if d - self.radius <= k <= d + self.radius]
        return list(found.values())

    def add(self, value: int, linked: list[int]) -> int:
        """Put value into the tree as one class with the nodes in linked."""
        new = len(self.value)
        self.value.append(value)
        self.children.append({})
        self.parent.append(new)
        self.tag.append(new)
        for i in linked:
            self.parent[self.find(i)] = self.find(new)
        root, at = self.find(new), 0
        while new:  # tag: the class of a subtree all of whose nodes are in it, or -1
            if self.tag[at] >= 0 and self.find(self.tag[at]) != root:
                self.tag[at] = -1
            d = (self.value[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        return new


def _bucket_links(rows: list[tuple[int, int]], radius: int) -> Iterator[tuple[int, int]]:
    """Links (id, id) among one bucket's (fp, id)."""
    tree = BKTree(radius)
    for fp, rep in rows:
        linked = tree.near(fp)
        for i in linked:
            yield rows[i][1], rep
        tree.add(fp, linked)


def links(reps: DataFrame, radius: int = RADIUS, max_tree: int = MAX_TREE, blocks: int | None = None) -> DataFrame:
    """(a, b): enough links between ids of reps(fp, rep), one row per fingerprint, to join all that are within the radius."""
    blocks = blocks or choose_blocks(reps.count(), radius)
    masks = block_masks(blocks, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    rows = reps.select("fp", "rep", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp", "rep")
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n"))
    # buckets of one fingerprint have no links; large ones are split into shards, every pair of which meets once
    sizes = sizes.filter("n > 1").withColumn("shards", F.ceil(F.col("n") / max_tree).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
    pairs = F.expr("transform(sequence(0, shards - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j))")
    rows = rows.join(sizes, ["choice", "key"]).withColumn("own", own).withColumn("cell", F.explode(pairs))
    rows = rows.select("choice", "key", "cell.i", "cell.j", "fp", "rep")
    n = C.n_partitions(reps)
    rows = rows.repartition(n, "choice", "key", "i", "j").sortWithinPartitions("choice", "key", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            *key, fps, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            for at, fp, rep in zip(zip(*(c.tolist() for c in key), strict=True), fps.view(np.uint64).tolist(), ids.tolist(), strict=True):
                if at != now:
                    out += _bucket_links(held, radius)
                    now, held = at, []
                held.append((fp, rep))
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        out += _bucket_links(held, radius)
        if out:
            yield _edges(out)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): each linked id and the smallest id it reaches, by alternating large-star and small-star steps."""
    spark, path, before = edges.sparkSession, C.shared_dir(edges.sparkSession), None
    edges = C.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), path)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in "uv"])).alias("e"))
        small = small.select("e.u", "e.v").filter("u <> v").distinct()
        old, path = path, C.shared_dir(spark)
        edges = C.stored(small, path)
        C.remove_path(spark, old)
        # stars that point to their smallest member don't change any more: same rows, same sums
        now = edges.agg(F.count("*"), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def simhash_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, max_tree: int = MAX_TREE, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the fingerprint in hex and the smallest id that links reach."""
    prints = C.stored(with_fingerprint(C.id_text(df, id_col, text_col), shingle))
    reps = C.stored(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # ids that repeat with other texts tie their fingerprints together
    same = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    same = same.select("x", F.explode("fps").alias("y")).filter("x <> y")
    rep = lambda n, m: reps.select(F.col("fp").alias(n), F.col("rep").alias(m))
    tied = same.join(rep("x", "a"), "x").join(rep("y", "b"), "y").select("a", "b")
    classes = connected(links(reps, radius, max_tree, blocks).unionByName(tied))
    named = reps.join(classes, reps.rep == classes.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
