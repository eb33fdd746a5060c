"""Corpus-wide search by inverted index: near-duplicate classes and shared fingerprints with a benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as T
from ..storage import spread, stored

#: Frequent shingles that are known to every worker at most (8 bytes each), and from how many documents on one is frequent.
MOST_FREQUENT, FREQUENT = 200_000, 16


def _clean(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = spread(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    return raw.select("id", "raw", T.clean_text(F.col("raw")).alias("clean"))


def shingle_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, window: int = 4) -> DataFrame:
    """(id, prints): winnowed hashes of runs of `shingle` cleaned words."""
    return _clean(docs, id_col, text_col).select("id", kernels.shingle_prints(F.col("clean"), shingle, window).alias("prints"))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, prints): the 64-bit hashes of all distinct runs of `shingle` cleaned words in ascending order, none left out.

    A text of fewer words is one shingle: all its words or, without words or with letters or digits that cleaning drops, the
    lower-cased text itself. So only equal short texts are alike, and no set is empty.
    """
    clean = _clean(docs, id_col, text_col)
    words = T.tokens(F.col("clean"))
    lower = T.normalize_whitespace(F.lower("raw"))
    own = F.when((F.size(words) == 0) | lower.rlike(r"[\p{L}\p{M}\p{N}&&[^\x00-\x7F]]"), lower).otherwise(F.array_join(words, " "))
    return clean.select("id", kernels.shingle_hashes(F.col("clean"), F.when(F.size(words) < shingle, own), shingle).alias("prints"))


def _prefixes(sets: DataFrame, least: float, frequent: np.ndarray) -> DataFrame:
    """(id, key, n, prefix): a set's 128-bit key and size, and the shingles of which sets that overlap by `least` share one.

    Of n shingles in an order that all documents share, these are the first n - ceil(least n) + 1: frequent ones come last.
    """
    known = sets.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        often = known.value
        for batch in batches:
            lists = batch.column("prints")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            late = np.isin(flat, often, kind="sort") if len(often) else np.zeros(len(flat), bool)
            keys, prefixes = [], []
            for a, b in zip(ends, ends[1:], strict=False):
                part, rear = flat[a:b], late[a:b]
                keys.append(hashlib.md5(part.tobytes()).hexdigest())
                k = len(part) - int(np.ceil(len(part) * least - 1e-9)) + 1
                prefixes.append((np.concatenate([part[~rear], part[rear]]) if rear.any() else part)[:k])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys, pa.string()), pa.array(np.diff(ends)), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "key", "n", "prefix"])

    return sets.mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, key string, n int, prefix array<bigint>")


def keyed_sets(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(id, class_id, n, prefix), written once: classes are of equal sets, named by the smallest id.

    The order of shingles is that of their hashes; those that are in many documents' prefixes by it are put last.
    """
    first = _prefixes(sets, least, np.zeros(0, np.int64))
    often = first.select(F.explode("prefix").alias("p")).groupBy("p").agg(F.count("*").alias("df")).filter(F.col("df") >= FREQUENT)
    frequent = often.orderBy(F.desc("df"), "p").limit(MOST_FREQUENT).select("p").toArrow().column("p").to_numpy()
    rows = stored(_prefixes(sets, least, frequent))
    least_id = rows.groupBy("key").agg(F.min("id").alias("class_id"))
    return rows.join(least_id, "key").select("id", "class_id", "n", "prefix")


def near_duplicate_links(sets: DataFrame, least: float = 0.8, keyed: DataFrame | None = None) -> DataFrame:
    """(id_a, id_b, similarity): pairs of classes of equal shingle sets whose Jaccard overlap is `least` or more.

    Classes go by their smallest id. Pairs whose prefixes share a shingle are candidates, unless sizes or the shingle's
    places rule the overlap out; each is then compared by its whole sets. No cap, no link is lost.
    """
    keyed = keyed_sets(sets, least) if keyed is None else keyed
    reps = keyed.filter("id = class_id").select("class_id", "n", F.posexplode("prefix").alias("at", "p"))
    a, b = (reps.select(F.col("class_id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"), "p") for x in "ab")
    alike = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9
    # at most as many shingles are shared as come before the shared one on either side, it, and as come after it
    most = F.least("at_a", "at_b") + 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    enough = most >= F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    near = stored(a.join(b, "p").filter((F.col("id_a") < F.col("id_b")) & alike).filter(enough).select("id_a", "id_b").distinct())
    ids = near.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    whole = stored(sets.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    for x in "ab":
        near = near.join(whole.select(F.col("id").alias(f"id_{x}"), F.col("prints").alias(f"p_{x}")), f"id_{x}")
    shared = F.size(F.array_intersect("p_a", "p_b"))
    likeness = shared / (F.size("p_a") + F.size("p_b") - shared)
    return near.select("id_a", "id_b", likeness.alias("similarity")).filter(F.col("similarity") >= least)


def near_duplicates(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_links) of every document: its class of equal sets, and how many other classes that is linked to."""
    keyed = keyed_sets(sets, least)
    links = near_duplicate_links(sets, least, keyed)
    each = links.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return keyed.join(each, "class_id", "left").select(F.col("id").alias("doc_id"), "class_id", F.coalesce("links", F.lit(0)).alias("n_links"))


def shared_prints(prints: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, containment): prints that a document shares with a benchmark item, of the item's."""
    d = prints.select(F.col("id").alias("doc_id"), F.explode("prints").alias("p"))
    i = items.select(F.col("id").alias("item_id"), F.size("prints").alias("n"), F.explode("prints").alias("p"))
    return d.join(i, "p").groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("shared")).select("doc_id", "item_id", "shared", T.rounded(F.col("shared") / F.col("n")).alias("containment"))
