"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

The distinct words of a slice of rows make up a corpus: all their bytes stand in one array of symbols, linked to their
neighbours. An inverted index leads from ranks of merges to the positions of their pairs. Ranks are replayed in order,
a band of neighbouring ranks at a time, all words side by side: in each step a word's pairs of its lowest rank merge,
and only the two neighbours of each merge get a new rank, which enters the index, in this band or a later one. A new
pair may rank below the merge that made it; it goes first then, as it would in the tiktoken library: a word in which
that happens merges one pair a step. A word that is a token itself is that token. Words are matches of `pattern`, each
encoded by itself, without special tokens. Everything but the matching is done on arrays; nothing is kept between slices.

Null and empty texts have no ids. Every row is encoded alone, whatever its id (null and repeated ids too); an empty table
stays empty. Columns other than the id and the text aren't read, so their names can't clash. Ids are little-endian
unsigned 32-bit integers. A text longer than a slice is a slice of its own; memory is about 30 bytes for each byte of
the slice's distinct words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text_batches
from .pieces import gathered, regrouped, slices


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Bytes of text whose distinct words are replayed together, and bands of ranks.
SLICE, BANDS = 1 << 22, 48
NONE = np.int32(2**31 - 1)


#: Words that are one match, or two with the marks that follow: spaces aside, letters up to U+024F and no apostrophe.
PLAIN = r"^(?P<a> ?[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once; by sorting, which is faster here than the hashing of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class PairTable:
    """A hash table from 64-bit keys to values, looked up for many keys at once; open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at = self.home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place, the last stays
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (1 << self.bits) - 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.home(keys)
        found, out = self.keys[at], self.values[at]
        miss = np.flatnonzero((found != keys) & (found >= 0))
        out[found != keys] = NONE
        while len(miss):
            at = (at if len(at) == len(miss) else at[miss]) + 1 & (1 << self.bits) - 1
            found = self.keys[at]
            hit = found == keys[miss]
            out[miss[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            at, miss = at[go], miss[go]
        return out


class Replay:
    """Encodes words by replaying merges over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens, self.ids = pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.table = PairTable(*(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256)).reshape(256, 256)
        # a band holds as many kinds of pairs as any other
        edges = distinct(np.array(sorted(r for _, r in pairs)[:: max(1, len(pairs) // BANDS)], np.int64))
        self.edges = np.append(edges[1:], NONE)
        self.place = np.zeros(int(self.ids.max()) + 1, np.int32)
        self.place[self.ids] = np.arange(len(self.ids), dtype=np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs' merges; NONE if a pair has none."""
        return self.table[a << 32 | b]

    def encode(self, words: pa.Array) -> pa.Array:
        """The ids of binary words, as little-endian uint32 bytes."""
        whole = pc.index_in(words, value_set=self.tokens)
        known = whole.is_valid().to_numpy(zero_copy_only=False)
        ids, n = self.replay(words.filter(pa.array(~known)))
        counts = np.ones(len(words), np.int64)
        counts[~known] = n
        out = np.empty(counts.sum(), "<u4")
        single = np.repeat(known, counts)
        out[single] = self.ids[whole.drop_null().to_numpy()]
        out[~single] = ids
        ends = np.zeros(len(words) + 1, np.int32)
        np.cumsum(4 * counts, out=ends[1:])
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(out)])

    def replay(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        total = len(data)
        symbol, word = self.single[data], np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        rank = np.full(total, NONE, np.int32)
        if total:
            rank[:-1] = self.of_bytes[data[:-1], data[1:]]
            full = np.flatnonzero(np.diff(ends))
            after[ends[full + 1] - 1], before[ends[full]] = -1, -1
            rank[ends[full + 1] - 1] = NONE
        alive = np.ones(total, bool)
        # the inverted index: positions of pairs by the band of their rank
        index: list[list[np.ndarray]] = [[] for _ in self.edges]

        def enter(at: np.ndarray) -> None:
            band = np.searchsorted(self.edges, rank[at], "right")
            order = np.argsort(band, kind="stable")
            cuts = np.searchsorted(band[order], np.arange(len(index) + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                index[b].append(at[order[cuts[b] : cuts[b + 1]]])

        enter(np.flatnonzero(rank < NONE))
        for band, high in enumerate(self.edges):
            if not index[band]:
                continue
            at = distinct(np.concatenate(index[band]))
            index[band], later = [], []
            at = at[rank[at] < high]
            while len(at):
                # each word's pairs of its lowest rank; of pairs that overlap, every other one
                new = np.flatnonzero(np.diff(word[at], prepend=-1))
                least = np.repeat(np.minimum.reduceat(rank[at], new), np.diff(np.append(new, len(at))))
                p = at[rank[at] == least]
                follows = np.zeros(len(p), bool)
                follows[1:] = after[p[:-1]] == p[1:]
                if follows.any():
                    run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(p))))
                    p = p[(np.arange(len(p)) - run) % 2 == 0]
                q = after[p]
                r, f, b = rank[p].astype(np.int64), after[q], before[p]
                right = np.where(f >= 0, self.rank(r, symbol[f]), NONE)
                left = np.where(b >= 0, self.rank(symbol[b], r), NONE)
                low = np.minimum(right, left)
                touch = np.zeros(len(p), bool)
                touch[1:] = f[:-1] == p[1:]
                if touch.any():  # two products side by side
                    low[touch] = np.minimum(low[touch], self.rank(r[touch], r[touch]))
                if (low < r).any():
                    wild = distinct(word[p[low < r]])
                    first = np.zeros(len(p), bool)
                    first[np.flatnonzero(np.diff(word[p], prepend=-1))] = True
                    p = p[first | ~np.isin(word[p], wild)]
                    q = after[p]
                    r, f = rank[p].astype(np.int64), after[q]
                symbol[p], after[p] = r, f
                before[f[f >= 0]] = p[f >= 0]
                rank[q], alive[q] = NONE, False
                b = before[p]
                b = b[b >= 0]
                rank[p] = np.where(f >= 0, self.rank(r, symbol[f]), NONE)
                rank[b] = self.rank(symbol[b], symbol[after[b]])
                touched = np.concatenate([p, b])
                now = rank[touched]
                later.append(touched[(now >= high) & (now < NONE)])
                at = at[rank[at] < high]
                near = touched[now < high]
                if len(near):
                    at = distinct(np.concatenate([at, near]))
            if later:
                due = distinct(np.concatenate(later))
                enter(due[rank[due] < NONE])
        so_far = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], np.diff(so_far[ends])


class Codec:
    """A rank file with its pattern."""

    _held: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.replay, self.match = Replay(load_ranks(path)), regex.compile(pattern).findall

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._held:
            cls._held[path, pattern] = cls(path, pattern)
        return cls._held[path, pattern]

    def ids_of(self, pieces: pa.Array) -> pa.Array:
        """The ids of each distinct piece: of its matches, joined."""
        plain = pc.extract_regex(pieces, PLAIN)
        odd = np.flatnonzero(plain.is_null().to_numpy(zero_copy_only=False))
        matches = list(map(self.match, pieces.take(pa.array(odd)).to_pylist()))
        one, two = plain.field(0), plain.field(1)
        words = pa.concat_arrays([one.fill_null(""), two.fill_null(""), pa.array([w for m in matches for w in m], pa.string())]).dictionary_encode()
        n = np.full(len(pieces), 2)
        n[odd] = list(map(len, matches))
        ends = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        # places of a piece's words: its own and that of its marks, or a run of matches behind all of these
        at, wild = np.empty(ends[-1], np.int64), np.zeros(len(pieces), bool)
        wild[odd] = True
        spread = np.repeat(wild, n)
        usual = np.flatnonzero(~wild)
        at[~spread] = np.stack([usual, usual + len(pieces)], 1).ravel()
        at[spread] = np.arange(spread.sum()) + 2 * len(pieces)
        coded = words.indices.to_numpy()[at]
        return regrouped(self.replay.encode(words.dictionary.cast(pa.binary())).take(pa.array(coded)), ends)

    def encode(self, column: pa.Array) -> pa.Array:
        return gathered(column, self.ids_of)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes that each row of ids stands for."""
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
        return regrouped(self.replay.tokens.take(pa.array(self.replay.place[flat])), (ends - ends[0]) // 4)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text; no shuffle. With `decoded`, also the bytes that the ids stand for,
    by the same worker: a separate decode() would have a second Python process for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for part in slices(batches, size=SLICE):
            ids = codec.encode(part.column("text"))
            columns = {"doc_id": part.column("doc_id"), "n_tokens": pc.divide(pc.binary_length(ids), 4).cast(pa.int64()), "ids": ids}
            if decoded:
                columns["decoded"] = codec.decode(ids)
            yield pa.RecordBatch.from_pydict(columns)
            del part, ids, columns
            pa.default_memory_pool().release_unused()

    whole_text_batches(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for, no bytes where they are null; a column named `out_col` is replaced."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        return Codec.of(ranks_path, pattern).decode(ids)

    return df.withColumn(out_col, run(F.coalesce(df[f"`{ids_col}`"], F.lit(b""))))
