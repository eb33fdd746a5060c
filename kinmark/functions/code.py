"""Source-code columns: language, comments, tokens, names, k-grams and winnowing, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CPP_SIGNALS, JAVA_SIGNALS, LEXERS, PYTHON_SIGNALS
from .text import jaccard, let, normalize_whitespace

K, WINDOW = 3, 4


def signals(text: Column, of: list[str]) -> Column:
    total = F.lit(0)
    for s in of:
        total = total + text.contains(s).cast("int")
    return total


def detect_language(text: Column) -> Column:
    """python, cpp or java, the first with the most signals; Java's count in their own case."""
    p, c, j = signals(F.lower(text), PYTHON_SIGNALS), signals(F.lower(text), CPP_SIGNALS), signals(text, JAVA_SIGNALS)
    return F.when((p >= c) & (p >= j), "python").when(c >= j, "cpp").otherwise("java")


def known(lang: Column) -> Column:
    """Languages without a lexer of their own are read like Python."""
    low = F.lower(lang)
    return F.when(low.isin("java", "cpp"), low).otherwise("python")


def _python_clean(x: Column) -> Column:
    for pattern in (r'(?s)""".*?"""', r"(?s)'''.*?'''", r"(?md)#.*?$"):
        x = F.regexp_replace(x, pattern, "")
    return normalize_whitespace(x)


def _c_clean(x: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(F.regexp_replace(x, r"(?s)/\*.*?\*/", ""), r"(?md)//.*?$", ""))


def clean_code(x: Column, lang: Column) -> Column:
    return F.when(known(lang) == "python", _python_clean(x)).otherwise(_c_clean(x))


def tokenize(clean: Column, lang: Column) -> Column:
    found = {name: F.regexp_extract_all(clean, F.lit(p), F.lit(0)) for name, p in LEXERS.items()}
    return F.when(known(lang) == "java", found["java"]).when(known(lang) == "cpp", found["cpp"]).otherwise(found["python"])


def kgrams(words: Column, k: int = K) -> Column:
    """Runs of k tokens, joined without a separator."""

    def runs(w: Column) -> Column:
        n = F.size(w) - k + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), ""))
        return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def hashes(grams: Column) -> Column:
    return F.transform(grams, lambda g: F.md5(g.cast("binary")))


def winnow(h: Column, w: int = WINDOW) -> Column:
    """The set of least hashes of windows of w; a shorter array has one window."""

    def minima(x: Column) -> Column:
        n = F.size(x) - w + 1
        least = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_min(F.slice(x, i, w)))
        return F.when(F.size(x) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(least))

    return let(h, minima)


def winnow_similarity(a: Column, b: Column, prints_a: Column, prints_b: Column, k: int = K) -> Column:
    short = (F.size(a) < k) | (F.size(b) < k)
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(one_empty, 0.0).when(short, jaccard(a, b)).otherwise(jaccard(prints_a, prints_b))


def sequence_distance(a: Column, b: Column) -> Column:
    """Likeness of two strings that write one node type a character: 1 - edit distance / longer length."""
    n, m = F.length(a), F.length(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(n, m)))
