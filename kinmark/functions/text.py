"""Text columns: cleaning, tokens, terms and set overlap, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import STOP_WORDS

#: Inverse document frequency, over two documents, of a term that only one has; of a shared term it is 1.
KAPPA = 1.4054651081081644


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up on the binary value, by plain arithmetic that every engine does alike."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: lambdas would otherwise compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def clean_text(x: Column) -> Column:
    """Lower case; what isn't a-z, 0-9, white space or an apostrophe becomes a space; single spaces."""
    return normalize_whitespace(F.regexp_replace(F.lower(x), r"[^a-z0-9\s']", " "))


def tokens(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def without_stop_words(words: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Order and repeats stay."""
    return F.filter(words, lambda t: ~t.isin(*stop))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def risk(score: Column) -> Column:
    return F.when(score < 0.30, "LOW").when(score < 0.50, "MEDIUM").otherwise("HIGH")


def fused_text(jaccard_: Column, lcs: Column, cosine: Column) -> Column:
    return 0.2 * jaccard_ + 0.2 * lcs + 0.6 * cosine


def fused_code(winnowing: Column, lcs: Column, ast: Column) -> Column:
    """Weights with a syntax score, and without one (other languages)."""
    return F.when(ast.isNull(), 0.8 * lcs + 0.2 * winnowing).otherwise(0.4 * winnowing + 0.3 * lcs + 0.3 * ast)
