"""A training corpus from raw documents: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage is fed with what its predecessor wrote. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.llm import bpe, common, decontam, line_dedup, simhash, toxicity
from kinmark.llm.queries import MULTI_RANKS, table, toxicity_model

#: Scores from here on are rejected.
TOXIC = 0.5
#: SQL cannot express the machine's training, XXH64 fingerprints or merges: tests/llm checks run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC; the model comes from the labelled input documents.

    Rows are judged by their text alone, so repeated and null ids change nothing; null and empty texts have the bias's score.
    """
    model = toxicity_model(spark, sf_dir)
    return docs.filter(toxicity.score_column(docs, model, F.col("text")) < TOXIC)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; n_chars, if it is there, follows the text. A null text stays null.

    Rows that repeat an id are one document to the count of lines, and each loses its lines; rows without an id lose none.
    """
    gone = line_dedup.repeated_lines(docs, "doc_id", "text")
    kept, n, dropped = (common.unused(docs, x) for x in ("kept_text", "n_lines", "n_dropped"))
    out = line_dedup.without_lines(docs, gone, "doc_id", "text", kept, n, dropped)
    changed, new = F.col(dropped) > 0, {"text": F.when(F.col(dropped) > 0, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked fingerprints; rows without an id stay.

    Rows that repeat an id are one document: all of them stay or go. Null and empty texts are alike, so one of them stays.
    """
    classes = simhash.simhash_classes(docs)
    extra = classes.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark, whether its items have ids or not.

    Rows are judged by their text, so of rows that repeat an id or have none some can go; null and empty texts stay.
    """
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    own_id, own_key = common.unused(docs, "id"), common.unused(docs, "key")
    bad = found.filter("contaminated").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_key == F.col(own_key)), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids (little-endian uint32) of each row; null texts have no ids."""
    decoded = bpe.encode(docs, MULTI_RANKS, public_tokenizers.PATTERN, decoded=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to `documents`, each written to shared storage and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
