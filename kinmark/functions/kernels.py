"""Sequence kernels that have no built-in counterpart, as Arrow-batched functions."""

from __future__ import annotations

import ast
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from . import hashing
from .lexicon import KEYWORDS, LEXERS

#: Aligned blocks: a score and the first and last lines on either side.
BLOCKS = ArrayType(StructType().add("score", DoubleType()).add("file_a_region", ArrayType(IntegerType())).add("file_b_region", ArrayType(IntegerType())))

#: Stand-ins for syntax nodes where there is no parser.
MARKS = "class struct if else for while do switch case return try catch throw new { } ( ) ;".split()
#: A character for each type of node.
ALPHABET = {name: chr(0x4E00 + i) for i, name in enumerate([*MARKS, *sorted(n for n, x in vars(ast).items() if isinstance(x, type) and issubclass(x, ast.AST))])}


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if m := where.get(y):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_len(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def text_lcs(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(lcs_len(a, b) / least)


def code_lcs(a: Column, b: Column, cap: int | None = None) -> Column:
    """Over the longer length; 1 if both are empty, 0 if one is. `cap` takes the first tokens only, for parity with the reference."""
    if cap is not None:
        a, b = F.slice(a, 1, cap), F.slice(b, 1, cap)
    most, least = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).when(least == 0, 0.0).otherwise(lcs_len(a, b) / most)


#: What is cut from programs before their tokens are read: literals of several lines and comments.
CUTS = {"python": [re.compile(x) for x in (r'(?s)""".*?"""', r"(?s)'''.*?'''", r"(?m)#.*?$")], "java": [re.compile(x) for x in (r"(?s)/\*.*?\*/", r"(?m)//.*?$")]}
CUTS["cpp"] = CUTS["java"]
#: The lexers in Python's dialect.
LEX = {lang: re.compile(p.replace(r"\p{Nd}", r"\d")) for lang, p in LEXERS.items()}


def code_words(code: str, lang: str) -> list[str]:
    """Tokens of a program, names as var1, var2, ... by first appearance; one pass, whatever the number of names."""
    lang = lang if lang in LEX else "python"
    for cut in CUTS[lang]:
        code = cut.sub("", code)
    keywords, names, out = frozenset(KEYWORDS[lang]), {}, []
    for t in LEX[lang].findall(code):
        if (t[0].isalpha() or t[0] == "_") and t not in keywords:
            if t not in names:
                names[t] = f"var{len(names) + 1}"
            t = names[t]
        out.append(t)
    return out


def gram_digests(words: list[str], k: int = 3) -> list[str]:
    """MD5 of each run of k tokens, joined without a separator."""
    return [hashlib.md5("".join(words[i : i + k]).encode()).hexdigest() for i in range(len(words) - k + 1)]


def winnowed(digests: list[str], w: int = 4) -> list[str]:
    """The distinct least digests of windows of w; fewer digests are one window."""
    if len(digests) < w:
        return [min(digests)] if digests else []
    return list(dict.fromkeys(map(min, *(digests[i:] for i in range(w)))))


def code_columns(code: Column, lang: Column, *fields: str) -> Column:
    """A struct of the given ones of words, digests and prints (arrays of strings) of programs; a null one is empty."""

    @F.arrow_udf("struct<" + ", ".join(f"{f}: array<string>" for f in fields) + ">")
    def run(code: pa.Array, lang: pa.Array) -> pa.Array:
        rows = []
        for c, x in zip(code.to_pylist(), lang.to_pylist(), strict=True):
            row = {"words": code_words(c or "", (x or "").lower())}
            if fields != ("words",):
                row["digests"] = gram_digests(row["words"])
                row["prints"] = winnowed(row["digests"]) if "prints" in fields else None
            rows.append([row[f] for f in fields])
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, pa.list_(pa.string())) for c in columns], list(fields))

    return run(code, lang)


def shingle_prints(clean: Column, shingle: int, window: int) -> Column:
    """Winnowed digests of runs of words of a cleaned text, each word with a space behind it."""

    @F.arrow_udf("array<string>")
    def run(clean: pa.Array) -> pa.Array:
        texts = (x or "" for x in clean.to_pylist())
        return pa.array([winnowed(gram_digests([w + " " for w in x.split(" ") if w], shingle), window) for x in texts], pa.list_(pa.string()))

    return run(clean)


def shingle_hashes(clean: Column, own: Column, shingle: int) -> Column:
    """The distinct 64-bit hashes, ascending, of runs of words of a cleaned text; where `own` is not null, its hash alone."""

    @F.arrow_udf("array<bigint>")
    def run(clean: pa.Array, own: pa.Array) -> pa.Array:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(clean)
        for c in hashing.chunks([x or "" for x in clean.to_pylist()]):
            grams = hashing.gram_hashes(c.hashes(), shingle).view(np.int64)
            for row, a, n in zip(c.rows, c.first.tolist(), c.n_words.tolist(), strict=False):
                if n >= shingle:
                    part = np.sort(grams[a : a + n - shingle + 1])
                    out[row] = part[np.concatenate([[True], part[1:] != part[:-1]])]
        for i, x in enumerate(own.to_pylist()):
            if x is not None:
                out[i] = np.frombuffer(hashlib.md5(x.encode()).digest()[:8], np.int64)
        return pa.array(out, pa.list_(pa.int64()))

    return run(clean, own)


class Terms:
    """Words and terms of cleaned texts: the two stop lists and the lemmas."""

    def __init__(self, stop: list[str], tfidf_stop: list[str], lemmas: dict[str, str]):
        self.stop, self.tfidf_stop, self.lemmas = frozenset(stop), frozenset(tfidf_stop), lemmas
        self.pattern = re.compile("[a-z0-9]{2,}")

    def words(self, clean: str) -> list[str]:
        return [w for w in clean.split(" ") if w and w not in self.stop]

    def counts(self, clean: str) -> Counter:
        """Words of two characters or more and pairs of neighbours, after lemmas and stop words."""
        lemma = self.lemmas
        text = clean if not lemma else " ".join([lemma.get(w, w) for w in clean.split(" ")])
        kept = [w for w in self.pattern.findall(text) if w not in self.tfidf_stop]
        return Counter(kept) + Counter(map(" ".join, zip(kept, kept[1:], strict=False)))


def cosine(a: Counter, b: Counter, kappa2: float) -> float | None:
    """TF-IDF over two documents: idf is 1 for shared terms, the square of others' is kappa2; None without any term."""
    if not a and not b:
        return None
    shared = a.keys() & b.keys()
    if not shared:
        return 0.0
    (sa, qa), (sb, qb) = ((sum(c[t] * c[t] for t in shared), sum(n * n for n in c.values())) for c in (a, b))
    dot = sum(a[t] * b[t] for t in shared)
    return dot / (math.sqrt(sa + kappa2 * (qa - sa)) * math.sqrt(sb + kappa2 * (qb - sb)))


def text_scores(clean_a: Column, clean_b: Column, terms: Terms, kappa2: float, *fields: str) -> Column:
    """A struct of the given ones of jaccard, lcs and cosine of two cleaned texts."""

    @F.arrow_udf("struct<" + ", ".join(f"{f}: double" for f in fields) + ">")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out: dict[str, list] = {f: [] for f in fields}
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = x or "", y or ""
            u, v = terms.words(x), terms.words(y)
            if "jaccard" in out:
                p, q = set(u), set(v)
                out["jaccard"].append(len(p & q) / len(p | q) if p or q else 1.0)
            if "lcs" in out:
                out["lcs"].append(lcs_length(u, v) / min(len(u), len(v)) if u and v else 0.0)
            if "cosine" in out:
                out["cosine"].append(cosine(terms.counts(x), terms.counts(y), kappa2))
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in out.values()], list(fields))

    return run(clean_a, clean_b)


def node_types(code: str, lang: str) -> list[str] | None:
    """Syntax nodes in preorder; None if the code can't be parsed.

    Python is parsed; for Java and C++, without a parser here, brackets, keywords and statement ends stand in (approximate).
    """
    if lang in ("java", "cpp"):
        return re.findall(r"\b(?:class|struct|if|else|for|while|do|switch|case|return|try|catch|throw|new)\b|[{}();]", code)
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        out.append(type(node).__name__)
        stack += reversed(list(ast.iter_child_nodes(node)))
    return out


@F.pandas_udf(ArrayType(StringType()))
def ast_nodes(code: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else node_types(c, x) for c, x in zip(code, lang, strict=True)])


#: Nodes of a sequence that the edit distance takes where a cap is asked for.
CAP = 8000


def node_chars(nodes: list[str] | None) -> str | None:
    """One character for each node, so that edit distance counts nodes; None stays.

    Nodes by other names than syntax has here get characters from their names' hash, beyond those of syntax.
    """
    return None if nodes is None else "".join([ALPHABET.get(x) or chr(0x20000 + int.from_bytes(hashlib.md5(x.encode()).digest()[:4]) % 0x20000) for x in nodes])


@F.pandas_udf(StringType())
def ast_chars(nodes: pd.Series) -> pd.Series:
    return pd.Series([node_chars(x) for x in nodes], dtype=object)


def align(a: list[tuple[str, int]], b: list[tuple[str, int]], match: int = 2, mismatch: int = -1, gap: int = -1, min_lines: int = 3, floor: float = 0.15, max_blocks: int = 10, cap: int | None = None) -> list[dict]:
    """Blocks of local alignment of (token, line) sequences, best first; rows and columns of a block are used up.

    A cell of used rows or columns is 0. The way back from the first highest cell goes along equal tokens, else up if the
    cell above is higher than that to the left, else left. Of the table, about 2 sqrt(n) rows are held: every sqrt(n)-th, and
    those between two of them, made again for the way back. `cap` takes the first tokens only, for parity with the reference.
    """
    a, b = a[:cap], b[:cap]
    n, m = len(a), len(b)
    code = {t: i for i, t in enumerate({t for t, _ in [*a, *b]})}
    x, y = np.array([code[t] for t, _ in a], int), np.array([code[t] for t, _ in b], int)
    free_a, free_b, out = np.ones(n, bool), np.ones(m, bool), []
    step_rows = math.isqrt(n) + 1
    most = match * min(n, m) - gap * m + 1
    for _ in range(max_blocks if n and m else 0):
        ramp = np.arange(m) * -gap + np.cumsum(~free_b) * most  # gaps from the left run between used columns only

        def below(above: np.ndarray, i: int) -> np.ndarray:
            """Row i of the table, from 1, by the row above it."""
            row = np.zeros(m + 1, np.int32)
            if free_a[i - 1]:  # noqa: B023
                step = np.maximum(above[:-1] + np.where(y == x[i - 1], match, mismatch), above[1:] + gap)
                step = np.where(free_b, np.maximum(step, 0), 0)  # noqa: B023
                row[1:] = np.where(free_b, np.maximum.accumulate(step + ramp) - ramp, 0)  # noqa: B023
            return row

        row = np.zeros(m + 1, np.int32)
        kept, top, i, j = [row], 0, 0, 0
        for r in range(1, n + 1):
            row = below(row, r)
            if r % step_rows == 0:
                kept.append(row)
            at = int(row.argmax())
            if row[at] > top:
                top, i, j = int(row[at]), r, at
        share = top / (match * min(n, m))
        if top <= 0 or share < floor:
            break
        rows, columns, part, first = [], [], [], -1
        while i > 0 and j > 0:
            if (i - 1) // step_rows * step_rows != first:
                first = (i - 1) // step_rows * step_rows
                part = [kept[first // step_rows]]
                for r in range(first + 1, i + 1):
                    part.append(below(part[-1], r))
            here, above = part[i - first], part[i - 1 - first]
            if here[j] <= 0:
                break
            rows.append(i - 1)
            columns.append(j - 1)
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
            elif above[j] > here[j - 1]:
                i -= 1
            else:
                j -= 1
        spans = [[min(s[k][1] for k in at), max(s[k][1] for k in at)] for s, at in ((a, rows), (b, columns))]
        if all(hi - lo + 1 >= min_lines for lo, hi in spans):
            out.append({"score": round(100 * share, 2), "file_a_region": spans[0], "file_b_region": spans[1]})
        free_a[rows], free_b[columns] = False, False
        if 1 - free_a.mean() > 0.85 or 1 - free_b.mean() > 0.85:
            break
    return out


def positioned(code: str, pattern: re.Pattern) -> list[tuple[str, int]]:
    """Tokens with their line, from 1."""
    return [(t, i) for i, line in enumerate(code.split("\n"), 1) for t in pattern.findall(line)]


@F.pandas_udf(BLOCKS)
def alignment_blocks(a: pd.Series, b: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([align(positioned(x, LEX.get(k, LEX["python"])), positioned(y, LEX.get(k, LEX["python"]))) for x, y, k in zip(a, b, lang, strict=True)])
