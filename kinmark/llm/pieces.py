"""Texts cut into pieces that encode alone, so that each distinct piece is encoded once a batch, and rarely once a worker.

A single space or line feed between two characters that aren't white space is a border of every match of the byte-level
pattern: a space starts the match that follows, a line feed is a match of its own. Texts with other white space (runs,
tabs, at an end) are encoded whole. Pieces are byte ranges of an Arrow column; their ids are looked up once for each
distinct piece of a slice and then gathered. Caches hold CACHE pieces at most, which bounds memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 500_000
#: Bytes of text that are cut and gathered at a time; a longer text is a slice of its own.
SLICE = 1 << 24
#: How the byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on in order.
SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Marks that make up one match after letters; the apostrophe, which begins matches of its own, isn't one.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
WITHIN = re.compile(r".\s", re.DOTALL)
#: White space beyond ASCII by the number of its UTF-8 bytes, read as one big-endian number.
WIDE = {n: np.array([int.from_bytes(c.encode(), "big") for c in map(chr, range(128, 0x3001)) if c.isspace() and len(c.encode()) == n]) for n in (2, 3)}
#: Class of a byte: 1 a space or line feed, 2 other white space, 3 and 4 lead bytes that white space of 2 and 3 bytes has.
KIND = np.zeros(256, np.uint8)
KIND[[c for c in range(128) if chr(c).isspace()]] = 2
KIND[[32, 10]] = 1
KIND[np.unique(WIDE[2] >> 8)], KIND[np.unique(WIDE[3] >> 16)] = 3, 4


def cut(column: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Pieces of the texts of a string column without nulls, and where each text's pieces begin (and the last ones end).

    The pieces joined are the texts; a space goes with the word after it. Texts that `whole` marks are a piece each.
    """
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = KIND[buf]
    border = np.flatnonzero(kind == 1)
    bad = [np.flatnonzero(kind == 2)]
    for wide, size in ((3, 2), (4, 3)):
        at = np.flatnonzero(kind == wide)
        code = np.zeros(len(at), np.int64)
        for j in range(size):  # texts are valid UTF-8, so a lead byte has its followers
            code = code << 8 | buf[at + j]
        bad.append(at[np.isin(code, WIDE[size])])
    bad.append(border[1:][np.diff(border) == 1])
    full = np.flatnonzero(np.diff(ends))  # empty texts have no piece
    odd = np.zeros(n + 1, bool)
    if whole is not None:
        odd[:n] = whole
    odd[full] = (kind[ends[full]] == 1) | (kind[ends[full + 1] - 1] == 1)
    odd[np.searchsorted(ends, np.concatenate(bad), "right") - 1] = True
    if odd.any():
        border = border[~odd[np.searchsorted(ends, border, "right") - 1]]
    line = border[buf[border] == 10] + 1  # a line feed is a piece by itself
    border = np.insert(border, np.searchsorted(border, line), line)
    starts = np.insert(border, np.searchsorted(border, ends[full]), ends[full])
    at = np.append(starts, len(buf)).astype(np.int32)
    keys = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(buf)])
    return keys, np.searchsorted(starts, ends)


def regrouped(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Binary values joined: row i has those from ends[i] on, up to ends[i + 1]."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1][ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), values.buffers()[2]])


def gathered(column: pa.Array, ids_of, tail: bytes = b"", whole: np.ndarray | None = None) -> pa.Array:
    """For each text the ids of its pieces, joined, then tail. ids_of: from an array of distinct pieces to their ids as bytes."""
    keys, first = cut(column, whole)
    coded = keys.dictionary_encode()
    found = pa.concat_arrays([ids_of(coded.dictionary), pa.array([tail], pa.binary())])
    at = coded.indices.to_numpy()
    if tail:
        at = np.insert(at, first[1:], len(found) - 1)
        first = first + np.arange(len(first))  # each text before has had its tail
    return regrouped(found.take(pa.array(at)), first)


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, in batches of about `size` bytes of text."""
    held, now = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        column, lo = batch.column(col), 0
        if not batch.num_rows:
            continue
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
        while lo < batch.num_rows:
            hi = max(lo + (not held), int(np.searchsorted(ends, ends[lo] + size - now, "right")) - 1)
            held.append(batch.slice(lo, hi - lo))
            now += int(ends[hi] - ends[lo])
            lo = hi
            if lo < batch.num_rows or now >= size:
                yield joined()
                held, now = [], 0
    if held:
        yield joined()


class Cache:
    """Ids of pieces in two generations: a full one becomes the old one, from which pieces in use return."""

    def __init__(self, encode, size: int = CACHE):
        self.encode, self.half, self.now, self.old = encode, size // 2, {}, {}

    def __getitem__(self, piece: str) -> bytes:
        found = self.now.get(piece)
        return self.add(piece) if found is None else found

    def has(self, piece: str) -> bool:
        return piece in self.now or piece in self.old

    def put(self, piece: str, ids: bytes) -> None:
        if len(self.now) >= self.half:
            self.old, self.now = self.now, {}
        self.now[piece] = ids

    def add(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        self.put(piece, found)
        return found


class LibraryEncoder:
    """The tokenizers library over pieces: encode(column) gives ids as bytes, two each where the vocabulary allows."""

    _held: dict[str, LibraryEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.one = [np.array([i], self.dtype).tobytes() for i in range(self.library.get_vocab_size())]
        self.model = self.library.model
        self.model._resize_cache(0)  # `known` does its work
        self.known = Cache(self.piece)

    @classmethod
    def of(cls, path: str) -> LibraryEncoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, text: str) -> bytes:
        lead = " " if text[0] == " " else ""
        base = text[len(lead) :]
        if base.isalpha():  # one match: straight to the library's merges
            shown = lead and SHOWN[32]
            shown += base if base.isascii() else base.encode().decode("latin-1").translate(SHOWN)
            return b"".join([self.one[t.id] for t in self.model.tokenize(shown)])
        letters = base.rstrip(MARKS)
        if letters != base and letters.isalpha():  # letters, then marks: two matches
            return self.known[lead + letters] + self.known[base[len(letters) :]]
        return self.whole(text)

    def pieces(self, distinct: pa.Array) -> pa.Array:
        found = distinct.to_pylist()
        out = list(map(self.known.now.get, found))
        for i, ids in enumerate(out):
            if ids is None:  # texts that stay whole have white space after their first character; they are not kept
                out[i] = self.whole(found[i]) if WITHIN.search(found[i]) else self.known.add(found[i])
        return pa.array(out, pa.binary())

    def encode(self, column: pa.Array, tail: bytes = b"") -> pa.Array:
        """Texts that hold an added token (as <|endoftext|>) go through the library as they are."""
        whole = np.zeros(len(column), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        return gathered(column, self.pieces, tail, whole)
