"""Hashes of words and of runs of words, over arrays of whole chunks of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD1B54A32D192ED03
#: Bytes of text that are hashed at a time; eight-byte arrays of this length are the largest ones held.
BLOCK = 1 << 18
#: White space of the word contracts: [\x20\x09-\x0D].
SPACES = np.zeros(256, np.bool_)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, i < n at least; base is odd, and so has an inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = max(n, BLOCK + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 8 * BLOCK:  # of a single giant word: not kept
            return both[0], both[1]
        _powers[base] = both[0], both[1]
    return _powers[base]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit words whose every output bit hangs on every input bit (splitmix64's finisher)."""
    h = h + np.uint64(salt & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(buf: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't separators."""
    sep = np.ones(len(buf) + 2, np.int8)
    sep[1:-1] = separator[buf]
    step = np.diff(sep)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes from prefix sums, mixed. Works in blocks of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        part = buf[lo : ends[j - 1]]
        power, inverse = powers(BASE, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out)


def gram_hashes(words: np.ndarray, size: int, base: int = BASE, salt: int = 0) -> np.ndarray:
    """Rabin-Karp: the hash of every run of size words, each from two prefix sums of a polynomial modulo 2**64."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        part = words[lo : min(lo + BLOCK, n) + size - 1]
        power, inverse = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mixed(part, salt) * power[: len(part)], out=total[1:])
        m = len(part) - size + 1
        out[lo : lo + m] = (total[size:] - total[:-size]) * inverse[:m]
    return mixed(out, salt)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, salt: int) -> np.ndarray:
    """The hash of each given run of words [start, end), the length included."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, lo + BLOCK)))
        part = words[lo : int(ends[i:j].max())]
        power, inverse = powers(base, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(mixed(part, salt) * power[: len(part)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out, salt)


class Chunk:
    """Some texts of a batch, their words hashed together: words of text i are [first[i], first[i + 1])."""

    def __init__(self, rows: list[int], texts: list[bytes], separator: np.ndarray):
        self.rows, self.texts = rows, texts
        self.buf = np.frombuffer(b" ".join(texts), np.uint8)
        self.starts, self.ends = spans(self.buf, separator)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        self.begin, self.first = begin, np.searchsorted(self.starts, begin)
        self.n_words = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text begin at it or later."""
        return np.repeat(self.first[1:], self.n_words) - np.arange(len(self.starts))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.n_words)


def chunks(texts: list[str], separator: np.ndarray = SPACES, translate: bytes | None = None) -> Iterator[Chunk]:
    """The texts of a batch in chunks of about BLOCK bytes; a longer text is a chunk of its own."""
    rows, part, size = [], [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass")
        if translate:
            b = b.translate(translate)
        if part and size + len(b) > BLOCK:
            yield Chunk(rows, part, separator)
            rows, part, size = [], [], 0
        rows.append(i)
        part.append(b)
        size += len(b)
    if part:
        yield Chunk(rows, part, separator)
