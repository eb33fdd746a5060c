"""Toxicity: a factorization machine over hashed terms.

Terms are the words of the whole text (lower-cased) and their first 4 to 7 bytes, hashed to 2**BITS buckets. Each of
the `terms` buckets that tell the classes apart best gives two features: the bucket occurs, and it makes up at least
1 / DENSE of the words. The score is the logistic of bias + sum of w + sum over pairs of <v_i, v_j>, so pairs such as
an insult with a mention of a group have weights of their own, which an additive model can't have.

Training reads rows of known label only: `fit` counts each bucket's documents by class in Spark over a sample of at most
about `sample` labelled rows (picked by a hash of the id, a documented bound) and picks the terms there; the rows' chosen
features, bounded by sample x terms, then train the machine on the driver. Scoring is one pass without a shuffle.
Only the text enters a score.

Null and empty texts have no terms: their score is the logistic of the bias. Without labelled rows, or with one class
only, no terms are chosen and the score is the share of toxic rows. Repeated rows score alike; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import whole_text_batches
from .decontam import FOLD

BITS, PREFIXES, DENSE = 20, (4, 5, 6, 7), 200
SAMPLE, TERMS, FACTORS, EPOCHS = 20_000, 2_000, 4, 12


def term_hashes(c: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the terms of a chunk: each word's own and those of its beginnings."""
    owner, words, out = np.arange(len(c.starts)), [], []
    for size in (None, *PREFIXES):
        long = np.flatnonzero(c.ends - c.starts > size) if size else owner
        starts = c.starts[long]
        ends = starts + size if size else c.ends
        h = _spans_hash(c, starts, ends)
        out.append((C.mixed(h, size or 0) >> np.uint64(64 - BITS)).astype(np.int32))
        words.append(long)
    return np.concatenate(words), np.concatenate(out)


def _spans_hash(c: C.Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte spans, from prefix sums that are kept with the chunk if it is of usual size."""
    if len(c.buf) > 4 * C.BLOCK:
        return C.word_hashes(c.buf, starts, ends)
    power, inverse = C.powers(C.BASE, len(c.buf) + 1)
    if not hasattr(c, "total"):
        c.total = np.zeros(len(c.buf) + 1, np.uint64)
        np.cumsum((c.buf.astype(np.uint64) + np.uint64(1)) * power[: len(c.buf)], out=c.total[1:])
    return C.mixed((c.total[ends] - c.total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Model:
    """Chosen buckets in order, and the machine: bias, weights and factors of 2 features a bucket."""

    buckets: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs of texts, ordered by row."""
        place = np.full(1 << BITS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        rows, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in C.chunks(texts, translate=FOLD):
            word, bucket = term_hashes(c)
            at = place[bucket]
            word, at = word[at >= 0], at[at >= 0]
            text = c.owner()[word]
            pair, n = np.unique(text.astype(np.int64) * len(self.buckets) + at, return_counts=True)
            text, at = pair // max(1, len(self.buckets)), pair % max(1, len(self.buckets))
            dense = n * DENSE >= c.n_words[text]
            row = np.asarray(c.rows, np.int64)[text]
            rows += [row, row[dense]]
            features += [2 * at, 2 * at[dense] + 1]
        row, feature = np.concatenate(rows), np.concatenate(features)
        order = np.lexsort((feature, row))
        return row[order], feature[order]

    def margin(self, n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """bias + linear + pairwise terms for n rows."""
        v = self.factor[feature]
        total = np.bincount(row, self.weight[feature], n) + self.bias
        for f in range(v.shape[1]):
            total += 0.5 * (np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n))
        return total

    def score(self, texts: list[str]) -> np.ndarray:
        return logistic(self.margin(len(texts), *self.features(texts)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(model: Model, row: np.ndarray, feature: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss, in small batches of rows in an order that the seed fixes."""
    n, width = len(label), 2 * len(model.buckets)
    rng = np.random.default_rng(seed)
    first = np.searchsorted(row, np.arange(n + 1))
    seen_w, seen_v, seen_b = np.full(width, 1e-2), np.full(model.factor.shape, 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            part = order[lo : lo + 128]
            size = first[part + 1] - first[part]
            at = np.repeat(first[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            r, f = np.repeat(np.arange(len(part)), size), feature[at]
            used, local = np.unique(f, return_inverse=True)
            w, v = model.weight[used], model.factor[used]
            each = v[local]
            sums = np.stack([np.bincount(r, each[:, k], len(part)) for k in range(v.shape[1])], 1)
            squares = np.bincount(r, (each**2).sum(1), len(part))
            out = model.bias + np.bincount(r, w[local], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            miss = (logistic(out) - label[part]) / len(part) * 16
            count = np.bincount(local, minlength=len(used)) / len(part)
            grad_w = np.bincount(local, miss[r], len(used)) + decay * w * count
            slope = miss[r][:, None] * (sums[r] - each)
            grad_v = np.stack([np.bincount(local, slope[:, k], len(used)) for k in range(v.shape[1])], 1) + decay * v * count[:, None]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            seen_b += miss.sum() ** 2
            model.weight[used] -= rate * grad_w / np.sqrt(seen_w[used])
            model.factor[used] -= rate / 4 * grad_v / np.sqrt(seen_v[used])
            model.bias -= rate * miss.sum() / np.sqrt(seen_b)
    return model


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, terms: int = TERMS, factors: int = FACTORS, epochs: int = EPOCHS) -> Model:
    """A model from the texts whose ids have a label; see the module for the bound on what is read of them."""
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("doc_id is not null and y is not null")
    total = known.count()
    if total > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    # at most about `sample` rows of 12 bytes: broadcast, so no text is shuffled
    rows = C.stored(C.id_text(df, id_col, text_col).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            found = np.zeros((2, 1 << BITS), np.int64)
            for c in C.chunks(batch.column("text").to_pylist(), translate=FOLD):
                word, bucket = term_hashes(c)
                pair = np.unique(c.owner()[word].astype(np.int64) << BITS | bucket)
                positive = y[np.asarray(c.rows)][pair >> BITS] > 0
                for k in (0, 1):
                    np.add.at(found[k], pair[positive == k] & (1 << BITS) - 1, 1)
            at = np.flatnonzero(found.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0][at]), pa.array(found[1][at])], ["bucket", "no", "yes"])

    n = rows.groupBy().agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("int")).alias("yes")).first()
    n, yes = n["n"], n["yes"] or 0
    empty = Model(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)))
    if not 0 < yes < n:
        empty.bias = float(np.clip(np.log(max(yes, 1e-9) / max(n - yes, 1e-9)), -20, 20)) if n else -20.0
        return empty
    counts = rows.mapInArrow(counted, "bucket long, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    # chi-square of occurrence against class
    a, b, p = F.col("yes"), F.col("no"), yes / n
    gap = a - (a + b) * p
    chi = gap * gap / ((a + b) * p * (1 - p) * (1 - (a + b) / (n + 1)))
    chosen = counts.filter(a + b >= 5).select("bucket", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(terms).toArrow()
    buckets = np.sort(chosen.column("bucket").to_numpy())
    rng = np.random.default_rng(1)
    model = Model(buckets, float(np.log(yes / (n - yes))), np.zeros(2 * len(buckets)), rng.normal(0, 0.01, (2 * len(buckets), factors)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature = model.features(batch.column("text").to_pylist())
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), lists], ["doc_id", "y", "features"])

    got = rows.mapInArrow(featured, "doc_id long, y int, features array<int>").orderBy("doc_id").toArrow()
    lists = got.column("features").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    feature, label = lists.values.to_numpy().astype(np.int64), (got.column("y").to_numpy() > 0).astype(float)
    return train(model, np.repeat(np.arange(len(label)), size), feature, label, epochs)


def score_column(df: DataFrame, model: Model, text: Column) -> Column:
    """The score of a text column, from 0 to 1; the model (under 1 MB) is broadcast."""
    whole_text_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts.tolist()))

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with the score of each whole text."""
    return df.withColumn(out_col, score_column(df, model, F.col(f"`{text_col}`")))
