"""Pair scores: text reports, code reports and the unified record over a relation of pairs.

A pair relation has (pair_id, text_a, text_b) for explicit texts, or (id_a, id_b) over prepared documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as K
from ..functions import kernels
from ..functions import text as T
from ..functions.lexicon import LEMMAS, STOP_WORDS, tfidf_stop_words
from ..storage import spread


#: Entries of a lemma table at most: it goes to every worker.
MOST_LEMMAS = 1_000_000


def lemma_table(lemmas: DataFrame | dict[str, str] | None) -> dict[str, str]:
    """Lemmas from a frame (word, lemma) or a dictionary; none means the small table of the lexicon."""
    if lemmas is None:
        return LEMMAS
    if isinstance(lemmas, dict):
        return lemmas
    rows = lemmas.select("word", "lemma").dropna().limit(MOST_LEMMAS + 1).collect()
    if len(rows) > MOST_LEMMAS:
        raise ValueError(f"a lemma table has {MOST_LEMMAS} entries at most")
    return {r["word"]: r["lemma"] for r in rows}


def prepare_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, clean, words): what the text scores need, computed once a document."""
    clean = spread(docs).select(F.col(id_col).alias("id"), T.clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias("clean"))
    return clean.select("id", "clean", T.without_stop_words(T.tokens(F.col("clean"))).alias("words"))


def neighbours(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pairs (d, d + 1) of ids that exist."""
    ids = docs.select(F.col(id_col).alias("id_a"))
    return ids.join(docs.select(F.col(id_col).alias("id_b")).hint("merge"), F.col("id_b") == F.col("id_a") + 1)


def text_scores(pairs: DataFrame, prepared: DataFrame, *fields: str, lemmas: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """(id_a, id_b) with the given ones of jaccard, lcs and cosine, by one kernel over both cleaned texts."""
    terms = kernels.Terms(STOP_WORDS, tfidf_stop_words(), lemma_table(lemmas))
    scores = kernels.text_scores(F.col("clean_a"), F.col("clean_b"), terms, T.KAPPA * T.KAPPA, *fields)
    return with_sides(pairs, prepared, ["clean"]).select("id_a", "id_b", scores.alias("s")).select("id_a", "id_b", "s.*")


def tfidf_cosine(pairs: DataFrame, prepared: DataFrame, lemmas: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """(id_a, id_b, cosine): TF-IDF over the two documents of each pair; null if neither has a term.

    Idf over two documents is 1 for shared terms and KAPPA for others, so integer sums of squares give the cosine.
    """
    return text_scores(pairs, prepared, "cosine", lemmas=lemmas)


def with_sides(pairs: DataFrame, prepared: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both documents, as name_a and name_b.

    Neither side is broadcast: Spark goes by the size of the files read, of which prepared columns are many times as large.
    """
    for x in "ab":
        pairs = pairs.join(prepared.select(F.col("id").alias(f"id_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns]).hint("merge"), f"id_{x}")
    return pairs


def text_report(pairs: DataFrame, prepared: DataFrame, lemmas: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """(id_a, id_b, jaccard, lcs, cosine, final_similarity, risk_level, error); the final score is of unrounded parts."""
    out = text_scores(pairs, prepared, "jaccard", "lcs", "cosine", lemmas=lemmas)
    final = T.rounded(T.fused_text(F.col("jaccard"), F.col("lcs"), F.col("cosine")))
    out = out.select("id_a", "id_b", *[T.rounded(F.col(c)).alias(c) for c in ("jaccard", "lcs", "cosine")], final.alias("final_similarity"))
    level = F.when(F.col("final_similarity").isNotNull(), T.risk(F.col("final_similarity")))
    return out.withColumns({"risk_level": level, "error": F.when(F.col("cosine").isNull(), "empty vocabulary")})


def compare_texts(pairs: DataFrame) -> DataFrame:
    """The text report of explicit texts (pair_id, text_a, text_b)."""
    docs = pairs.select(F.explode(F.array(*[F.struct((F.col("pair_id") * 2 + i).alias("doc_id"), F.col(c).alias("text")) for i, c in enumerate(("text_a", "text_b"))])).alias("d")).select("d.*")
    ids = pairs.select((F.col("pair_id") * 2).alias("id_a"), (F.col("pair_id") * 2 + 1).alias("id_b"))
    return text_report(ids, prepare_text(docs)).withColumn("pair_id", (F.col("id_a") / 2).cast("long")).drop("id_a", "id_b")


def prepare_code(docs: DataFrame, id_col: str = "doc_id", code_col: str = "text", lang=None, fields: tuple[str, ...] = ("words", "prints")) -> DataFrame:
    """(id, lang, code, words, prints): normalised tokens and winnowing fingerprints, or the given `fields`, computed once a program."""
    raw = F.coalesce(F.col(code_col), F.lit(""))
    lang = F.coalesce(F.lower(F.nullif(lang, F.lit(""))), K.detect_language(raw)) if lang is not None else K.detect_language(raw)
    out = spread(docs).select(F.col(id_col).alias("id"), lang.alias("lang"), raw.alias("code"))
    columns = kernels.code_columns(F.col("code"), F.col("lang"), *fields)
    return out.select("id", "lang", "code", columns.alias("c")).select("id", "lang", "code", "c.*")


def ast_ngrams(nodes, n: int = 3):
    return F.array_distinct(K.kgrams(F.transform(nodes, lambda x: F.concat(x, F.lit(" "))), n))


def ast_likeness(a, b, n: int = 3):
    """Jaccard overlap of node n-grams (n = 1: of node types); 0 where a side can't be parsed."""
    grams = (ast_ngrams(a, n), ast_ngrams(b, n)) if n > 1 else (F.array_distinct(a), F.array_distinct(b))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(T.jaccard(*grams))


def ast_edit_likeness(a, b):
    """Edit likeness of two node sequences written by kernels.ast_chars; 0 where a side can't be parsed."""
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(K.sequence_distance(a, b))


def sequence_likeness(a, b, cap: int | None = None):
    """Edit likeness of two arrays of node names; `cap` takes the first nodes only."""
    if cap is not None:
        a, b = F.slice(a, 1, cap), F.slice(b, 1, cap)
    return K.sequence_distance(kernels.ast_chars(a), kernels.ast_chars(b))


def code_report(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """(id_a, id_b, lang_a, lang_b, winnowing, lcs, ast, final_similarity); ast only where both have one language."""
    nodes = prepared.withColumn("nodes", kernels.ast_nodes("code", "lang"))
    sides = with_sides(pairs, nodes, ["lang", "words", "prints", "nodes"])
    a = F.when(F.lower("lang_a") == F.lower("lang_b"), ast_likeness(F.col("nodes_a"), F.col("nodes_b")))
    w = K.winnow_similarity(F.col("words_a"), F.col("words_b"), F.col("prints_a"), F.col("prints_b"))
    out = sides.select("id_a", "id_b", "lang_a", "lang_b", w.alias("w"), kernels.code_lcs(F.col("words_a"), F.col("words_b")).alias("l"), a.alias("a"))
    return out.select("id_a", "id_b", "lang_a", "lang_b", T.rounded(F.col("w")).alias("winnowing"), T.rounded(F.col("l")).alias("lcs"), T.rounded(F.col("a")).alias("ast"), T.rounded(T.fused_code(F.col("w"), F.col("l"), F.col("a"))).alias("final_similarity"))


SCORES = ["jaccard", "cosine", "lcs", "winnowing", "ast"]


def unified_report(submissions: DataFrame) -> DataFrame:
    """(pair_id, mode, language, scores, final_similarity, risk_level, error) of (pair_id, mode, text_a, text_b, lang?).

    Blank inputs and unknown modes give a row with an error and no scores.
    """
    if "lang" not in submissions.columns:
        submissions = submissions.withColumn("lang", F.lit(None).cast("string"))
    blank = ~F.col("text_a").rlike(r"\S") | ~F.col("text_b").rlike(r"\S") | F.col("text_a").isNull() | F.col("text_b").isNull()
    checked = submissions.withColumn("bad", F.when(~F.col("mode").isin("text", "code") | F.col("mode").isNull(), "unknown mode").when(blank, "content is empty"))
    good = checked.filter("bad is null")
    text = compare_texts(good.filter("mode = 'text'").select("pair_id", "text_a", "text_b"))
    text = text.select("pair_id", F.lit("text").alias("mode"), F.lit("english").alias("language"), *[F.col(s) if s in ("jaccard", "cosine", "lcs") else F.lit(None).cast("double").alias(s) for s in SCORES], "final_similarity", "error")
    code = good.filter("mode = 'code'")
    docs = code.select(F.explode(F.array(*[F.struct((F.col("pair_id") * 2 + i).alias("doc_id"), F.col(c).alias("text"), "lang") for i, c in enumerate(("text_a", "text_b"))])).alias("d")).select("d.*")
    ids = code.select((F.col("pair_id") * 2).alias("id_a"), (F.col("pair_id") * 2 + 1).alias("id_b"))
    label = F.when(F.col("lang_a") != F.col("lang_b"), F.concat_ws("/", "lang_a", "lang_b")).otherwise(F.col("lang_a"))
    code = code_report(ids, prepare_code(docs, lang=F.col("lang"))).select((F.col("id_a") / 2).cast("long").alias("pair_id"), F.lit("code").alias("mode"), label.alias("language"), *[F.col(s) if s in ("winnowing", "lcs", "ast") else F.lit(None).cast("double").alias(s) for s in SCORES], "final_similarity", F.lit(None).cast("string").alias("error"))
    bad = checked.filter("bad is not null").select("pair_id", "mode", F.lit(None).cast("string").alias("language"), *[F.lit(None).cast("double").alias(s) for s in SCORES], F.lit(None).cast("double").alias("final_similarity"), F.col("bad").alias("error"))
    out = text.unionByName(code).unionByName(bad)
    return out.select("pair_id", "mode", "language", F.struct(*SCORES).alias("scores"), "final_similarity", F.when(F.col("final_similarity").isNotNull(), T.risk(F.col("final_similarity"))).alias("risk_level"), "error")
