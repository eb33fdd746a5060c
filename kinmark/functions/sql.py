"""The library's functions for SQL: after register(spark), SELECT jaccard_similarity(a, b) and the like work."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import kernels
from . import text as T
from .lexicon import CPP_SIGNALS, JAVA_SIGNALS, LEMMAS, PYTHON_SIGNALS, STOP_WORDS, tfidf_stop_words

_WORDS = "a ARRAY<STRING>, b ARRAY<STRING>"
_OVERLAP = "WHEN size(array_union({a}, {b})) = 0 THEN 1.0D ELSE size(array_intersect({a}, {b})) / size(array_union({a}, {b})) END"


def _sum(column: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words)


def _expressions() -> dict[str, tuple[str, str, str]]:
    """Functions that SQL expresses: parameters, type and body."""
    shingled = "array_distinct(transform(sequence(1, greatest(size({x}) - 2, 1)), i -> concat({x}[i - 1], {x}[i], {x}[i + 1])))"
    return {
        "clean_text": ("t STRING", "STRING", r"""trim(regexp_replace(regexp_replace(lower(t), r"[^a-z0-9\s']", ' '), r'\s+', ' '))"""),
        "risk_level": ("score DOUBLE", "STRING", "CASE WHEN score < 0.30 THEN 'LOW' WHEN score < 0.50 THEN 'MEDIUM' WHEN score IS NOT NULL THEN 'HIGH' END"),
        "jaccard_similarity": (_WORDS, "DOUBLE", "CASE " + _OVERLAP.format(a="a", b="b")),
        "detect_language": ("code STRING", "STRING", f"(SELECT CASE WHEN p >= c AND p >= j THEN 'python' WHEN c >= j THEN 'cpp' ELSE 'java' END FROM (SELECT {_sum('lower(code)', PYTHON_SIGNALS)} AS p, {_sum('lower(code)', CPP_SIGNALS)} AS c, {_sum('code', JAVA_SIGNALS)} AS j))"),
        "ngram_jaccard": (_WORDS, "DOUBLE", "CASE WHEN size(a) < 3 AND size(b) < 3 THEN 1.0D WHEN size(a) < 3 OR size(b) < 3 THEN 0.0D " + _OVERLAP.format(a=shingled.format(x="a"), b=shingled.format(x="b"))),
        "edit_similarity": ("a STRING, b STRING", "DOUBLE", "CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0D WHEN length(a) = 0 OR length(b) = 0 THEN 0.0D ELSE greatest(0.0D, 1 - levenshtein(a, b) / greatest(length(a), length(b))) END"),
        "cosine_similarity": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "least(greatest(aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (s, x) -> s + x) / (greatest(sqrt(aggregate(a, 0.0D, (s, x) -> s + CAST(x AS DOUBLE) * x)), 1e-10D) * greatest(sqrt(aggregate(b, 0.0D, (s, x) -> s + CAST(x AS DOUBLE) * x)), 1e-10D)), 0.0D), 1.0D)"),
    }


def _mapped(returns: str, body):
    """An Arrow function of one value of body for each row; null if an argument is null."""

    @F.arrow_udf(returns)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else body(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kinds[returns])

    kinds = {"double": pa.float64(), "array<string>": pa.list_(pa.string())}
    return run


def _winnowing(x: list[str], y: list[str]) -> float:
    if not x or not y:
        return float(x == y)
    a, b = (set(w) if min(len(x), len(y)) < 3 else set(kernels.winnowed(kernels.gram_digests(w))) for w in (x, y))
    return len(a & b) / len(a | b)


def _lcs(x: list[str], y: list[str], of) -> float:
    return kernels.lcs_length(x, y) / of(len(x), len(y))


def register(spark: SparkSession) -> list[str]:
    """Registers the functions for the session, in place of earlier ones; returns their names."""
    terms = kernels.Terms(STOP_WORDS, tfidf_stop_words(), LEMMAS)
    kappa2 = T.KAPPA * T.KAPPA
    kernels_of = {
        "text_words": _mapped("array<string>", lambda t, _: terms.words(t)),
        "lcs_similarity": _mapped("double", lambda x, y: _lcs(x, y, min) if x and y else 0.0),
        "code_lcs_similarity": _mapped("double", lambda x, y: _lcs(x, y, max) if x and y else float(x == y)),
        "tfidf_cosine": _mapped("double", lambda x, y: kernels.cosine(terms.counts(x), terms.counts(y), kappa2)),
        "code_words": _mapped("array<string>", lambda code, lang: kernels.code_words(code, lang.lower())),
        "ast_nodes": _mapped("array<string>", lambda code, lang: kernels.node_types(code, lang.lower())),
        "winnowing_similarity": _mapped("double", _winnowing),
    }
    for name, f in kernels_of.items():
        spark.udf.register(name, f)
    spark.udf.register("local_alignment", kernels.alignment_blocks)
    expressions = _expressions()
    for name, (parameters, returns, body) in expressions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return [*kernels_of, "local_alignment", *expressions]
