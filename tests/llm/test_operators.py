"""Each operator against a brute-force version, on the smallest tables and on a table of awkward rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from kinmark.llm import bitplane, bpe, ctph, decontam, html_extract, line_dedup, pieces, queries, sharding, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those that the operators give or use.
CLASH = ["key", "h", "start", "part", "score", "fp", "n_words", "starts", "bucket", "slot"]


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def awkward_rows():
    run = " ".join(f"w{i}" for i in range(70))
    line = "A line that is long enough to be counted as a key, yes"
    rows = [
        (1, run), (2, "x " + run + " y"), (3, None), (4, ""), (5, run), (6, " \t\n "), (7, f"{run} {run}"),
        (8, "Ä ö ü 漢字 😀  double  spaces\n\n\tTab"), (9, " ".join(["same"] * 120)), (10, " ".join(["same"] * 60)), (11, "a"), (12, "big " * 30000),
        *[(20 + i, f"  {line.upper() if i % 2 else line}\t\nown {i}\n{line}") for i in range(6)], (30, "a\nb\n"), (31, "don't we'll it's 123 4567 <|endoftext|> x"),
    ]
    return rows


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of tables with awkward documents, benchmark items and labels."""
    root = str(tmp_path_factory.mktemp("awkward"))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in awkward_rows()], SCHEMA)
    docs.selectExpr("*", *[f"'clash' AS {c}" for c in CLASH]).write.parquet(f"{root}/documents.parquet")
    items = [(1, "W3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13!"), (2, "tab"), (3, None), (4, ""), (10, "漢字 😀"), (11, "same same same"), (2, "nothing here"), (12, "q " * 400)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>x")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": SCHEMA, "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return root


def documents(spark, root):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect())


def got(spark, name, root):
    rows = queries.queries()[name](spark, root).collect()
    return {r[0]: tuple(r[1:]) for r in rows}, rows


@pytest.fixture(params=["sf", "awkward"])
def root(request):
    return request.getfixturevalue(request.param)


def test_substring_dedup(spark, root):
    docs, seen, want = documents(spark, root), {}, {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - 49):
            if tuple(w[k : k + 50]) in seen and seen[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), i)
        want[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got(spark, "op1_substring_dedup", root)[0] == want
    out = substring_dedup.substring_dedup(spark.read.parquet(f"{root}/documents.parquet"), sieve_bits=8)  # a sieve that lets all pass
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == want


def test_substring_dedup_of_hot_windows(spark, monkeypatch):
    """Whatever counts as hot, results are the same."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{f'u{i} ' * (i % 3)}{passage} {' '.join(f'w{i}x{k}' for k in range(70))} {passage if i % 4 == 0 else ''}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for hot in (10_000, 1, 10):
        monkeypatch.setattr(substring_dedup.C, "HOT", hot)
        got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect())
        want = want or got
        assert got == want and [n for _, n, _ in got][1:] == [60 * (1 + (i % 4 == 0)) for i in range(1, 24)]


def test_intervals():
    assert substring_dedup.intervals([(7, 1), (0, 2), (60, 1), (57, 1)], 50) == [(0, 110)]
    assert substring_dedup.intervals([(51, 3), (0, 1)], 50) == [(0, 50), (51, 103)]


def brute_simhash(docs):
    prints = {}
    for i, t in docs:
        w = words(lower(t))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash(spark, root):
    want = brute_simhash(documents(spark, root))
    assert got(spark, "op2_simhash", root)[0] == want
    out = simhash.simhash_classes(spark.read.parquet(f"{root}/documents.parquet"), max_tree=2, blocks=6)  # many blocks, shards of two
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want


def test_simhash_links_of_dense_prints(spark):
    rng, fps = np.random.default_rng(3), set()
    for _ in range(6):
        x = int(rng.integers(1 << 63))
        for _ in range(40):
            x ^= 1 << int(rng.integers(64))
            x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fps = sorted(fps)
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    for blocks, tree in ((5, 20_000), (7, 8)):
        found = {r.id: r.component for r in simhash.connected(simhash.links(reps, max_tree=tree, blocks=blocks)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == label


def test_connected_long_chain(spark):
    chain = simhash.connected(spark.range(200).selectExpr("id AS a", "id + 1 AS b"))
    assert {r.component for r in chain.collect()} == {0} and chain.count() == 200


def test_sharding():
    table = sharding.lookup_table(["a", "b", "c"], 7)
    assert set(table) == {0, 1, 2} and max(np.bincount(table)) - min(np.bincount(table)) <= 1
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(names, 2003), sharding.lookup_table(names[:-1], 2003)
    moved = ((before != after) & (before != 19)).mean()
    assert moved < 0.1
    heavy = np.bincount(sharding.lookup_table({"a": 1, "b": 3}, 2003))
    assert abs(heavy[1] / heavy[0] - 3) < 0.1
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def plain_filling(names, size):
    """Every shard's whole order of preference, and turns until no slot is free."""
    orders = []
    for name in names:
        digest = hashlib.md5(name.encode()).hexdigest()
        offset, step = int(digest[:16], 16) % size, int(digest[16:], 16) % (size - 1) + 1
        orders.append([(offset + i * step) % size for i in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    owner = {}
    while len(owner) < size:
        for shard, order in enumerate(orders):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = shard
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize(("n", "size"), [(1, 7), (3, 11), (7, 101), (64, 997)])
def test_sharding_table_by_plain_filling(n, size):
    names = [f"shard-{i:05d}" for i in range(n)]
    assert sharding.lookup_table(names, size).tolist() == plain_filling(names, size)


def test_sharding_query(spark, root):
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(64)])
    for i, (slot, shard) in got(spark, "op3_sharding", root)[0].items():
        assert slot == int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % 65537 and shard == table[slot]


def brute_decontam(docs, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    held = {}
    for i, t in items:
        w = words(lower(t), pattern)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes, want = {len(x) for x in held}, {}
    for i, t in docs:
        w, hit, found = words(lower(t), pattern), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := held.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        want[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return want


def test_decontamination(spark, root):
    bench = spark.read.parquet(f"{root}/benchmark.parquet")
    want = brute_decontam(documents(spark, root), [tuple(r) for r in bench.collect()])
    assert got(spark, "op4_decontamination", root)[0] == want
    out = decontam.decontaminate(spark.read.parquet(f"{root}/documents.parquet"), bench, block_bytes=500)  # many blocks
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()} == want


def test_parts_of_a_giant_item():
    """The parts have the item's windows, no others, and are of bounded size."""
    rng = np.random.default_rng(6)
    w = ["".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 9))))) + "é" * int(rng.integers(0, 2)) for _ in range(700)]
    windows = lambda x: {tuple(x[k : k + 10]) for k in range(len(x) - 9)}
    for most in (60, 200, 1000):
        parts = list(decontam.parts_of(", ".join(w), 10, most))
        assert set().union(*(windows(p.split()) for p in parts)) == windows(w) and len(parts) > 2
        assert all(len(p.encode()) <= max(most, 120) for p in parts)
    assert list(decontam.parts_of("a b", 10, 1)) == ["a b"] and list(decontam.parts_of("", 10, 0)) == [""]


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 40])
def test_decontamination_by_items_without_id(spark, block_bytes):
    nameless, short, named = " ".join(f"a{i}" for i in range(12)), "only three words", " ".join(f"b{i}" for i in range(10))
    bench = spark.createDataFrame([(None, nameless), (None, short), (7, named), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {nameless} y"), (2, f"{named} and {short}"), (3, "clean"), (4, None)], "doc_id long, text string")
    out = {r.doc_id: (r.n_hit, r.n_items, list(r["items"]), r.contaminated) for r in decontam.decontaminate(docs, bench, block_bytes=block_bytes).collect()}
    assert out == {1: (12, 0, [], True), 2: (13, 1, ["7"], True), 3: (0, 0, [], False), 4: (0, 0, [], False)}


def test_fingerprints(spark, root):
    docs, found = documents(spark, root), got(spark, "op5_fingerprints", root)[0]
    assert len(found) == len(docs)
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = map(ctph.fingerprint, (t, edited, u))
        assert found[i] == (len(t), sha(edited), a, b, ctph.likeness(a, b), ctph.likeness(a, c))


def plain_likeness(a, b):
    """By a table of edit distances with insertions and deletions, symbol by symbol."""
    if a == b:
        return 1.0
    sides = []
    for x in (a, b):
        size, *parts = x.split(":")
        sides.append({int(size) * 2**i: [p[k : k + 2] for k in range(0, len(p), 2)] for i, p in enumerate(parts)})
    common = sorted(set(sides[0]) & set(sides[1]))
    if not common or not sides[0][common[0]] or not sides[1][common[0]]:
        return 0.0
    x, y = sides[0][common[0]], sides[1][common[0]]
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        new = [i]
        for j, q in enumerate(y, 1):
            new.append(row[j - 1] if p == q else 1 + min(row[j], new[-1]))
        row = new
    return 1 - row[-1] / (len(x) + len(y))


def test_likeness_by_plain_edit_distance():
    rng = np.random.default_rng(8)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(400)]
    base = [str(x) for x in rng.choice(vocabulary, 900)]
    texts = ["", "a", "ab", " ".join(base)]
    for _ in range(40):
        copy = list(base[: int(rng.integers(5, 900))])
        for at in rng.integers(0, len(copy), int(rng.integers(0, 30))):
            copy[at] = "new"
        texts.append(" ".join(copy))
    prints = [ctph.fingerprint(t) for t in texts]
    between = 0
    for a in prints:
        for b in prints:
            assert ctph.likeness(a, b) == pytest.approx(plain_likeness(a, b))
            between += 0 < ctph.likeness(a, b) < 1
    assert between > 100


def test_fingerprint_follows_content():
    rng = np.random.default_rng(0)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000))
    moved = text[:9000] + " something put in between " + text[9000:]
    other = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000))
    a, b, c = map(ctph.fingerprint, (text, moved, other))
    assert ctph.likeness(a, b) > 0.9 and ctph.likeness(a, c) < 0.1 and ctph.likeness(a, a) == 1
    assert ctph.fingerprint("") == ctph.fingerprint(None) == "3:::"


def brute_fingerprint(data):
    """One byte at a time."""
    size, mask, weights = 3, (1 << 64) - 1, [int(x) for x in ctph._WEIGHTS]
    base, back = ctph.C.BASE, pow(ctph.C.BASE, -1, 1 << 64)

    def roll(i):
        r = sum((data[i - j] + 1) * weights[j] for j in range(7) if i >= j) & 0xFFFFFFFF
        r = (r ^ r >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        return r ^ r >> 13

    rolls = [roll(i) for i in range(len(data))]
    while size * 64 * 8 < len(data):
        size *= 2
    while size < len(data) and sum(r % size == size - 1 for r in rolls) >= 64:
        size *= 2
    out = [str(size)]
    for level in range(3):
        big, start, s = size << level, 0, ""
        for i in range(len(data)):
            if rolls[i] % big == big - 1 or i == len(data) - 1:
                h = sum((data[j] + 1) * pow(base, j - start, 1 << 64) for j in range(start, i + 1)) & mask
                s += ctph.PAIRS[int(ctph.C.mixed(np.array([h], np.uint64))[0] >> np.uint64(52))]
                start = i + 1
        out.append(s)
    assert back
    return ":".join(out)


def test_fingerprint_bytewise(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 50, 700, 3000):
        text = "".join(map(chr, rng.integers(97, 105, n)))
        assert ctph.fingerprint(text) == brute_fingerprint(text.encode())
    monkeypatch.setattr(ctph.C, "BLOCK", 64)
    assert ctph.fingerprint(text) == brute_fingerprint(text.encode())


def test_token_planes(spark, root):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.BYTE_BPE)
    want, start = {}, 0
    for i, text in documents(spark, root):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got(spark, "op6_token_planes", root)[0] == want


@pytest.mark.parametrize("plane", ["byte", "bit"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(plane, width):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 50_000, n).astype(f"<u{width}")
        sizes, data = bitplane.pack(ids, plane)
        assert (bitplane.unpack(sizes, data, n, width) == ids).all()


def test_pieces_encode_as_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), pieces.LibraryEncoder(path)
    gaps = [" ", "\n", "  ", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "'", "!"]
    words = ["one", "we're", "é", "№5", "日本", "x...", "<|endoftext|>", "''s", "ß!'"]
    texts = ["", *gaps, *(a + g + b for a in words for g in gaps for b in words), *(g + w for w in words for g in gaps), *(w + g for w in words for g in gaps), ""]
    want = [np.array(library.encode(t, add_special_tokens=False).ids + [7], "<u2").tobytes() for t in texts]
    encoder.known.half = 40  # generations change all the time
    column = pa.array(["before", *texts]).slice(1)
    assert encoder.encode(column, b"\7\0").to_pylist() == want
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for size in (1, 50, 1 << 20):
        parts = list(pieces.slices(iter([batch, batch.slice(0, 0), batch.slice(5)]), size=size))
        assert [x for p in parts for x in p.column("text").to_pylist()] == texts + texts[5:]


def test_small_blocks_round_trip(spark, awkward, tmp_path):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for plane in ("byte", "bit"):
        bitplane.write_ids(docs, f"{tmp_path}/{plane}", queries.BYTE_BPE, block_ids=50, plane=plane)
        small = {r[0]: tuple(r[1:]) for r in bitplane.read_summary(spark, f"{tmp_path}/{plane}").collect()}
        assert small == got(spark, "op6_token_planes", awkward)[0]


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.MULTI_RANKS), special_tokens={})


def test_bpe(spark, root, tik):
    want = {}
    for i, text in documents(spark, root):
        ids = tik.encode_ordinary(text or "")
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text or ""))
    assert got(spark, "op7_bpe", root)[0] == want


def test_replay_of_odd_ranks():
    """Merges whose product ranks below one of their parts: the lowest pair of a word still goes first."""
    import random

    import tiktoken

    random.seed(2)
    ranks = {bytes([b]): b for b in range(256)}
    names = ["ab", "ba", "aba", "bab", "abab", "aab", "baa", "abb", "bba", "abba", "aa", "bb"]
    for _ in range(60):
        random.shuffle(names)
        table = ranks | {n.encode(): 256 + i for i, n in enumerate(names)}
        enc = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=table, special_tokens={})
        texts = ["".join(random.choice("ab") for _ in range(random.randint(1, 14))) for _ in range(30)]
        got = bpe.Replay(table).encode(pa.array([t.encode() for t in texts], pa.binary())).to_pylist()
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [enc.encode_ordinary(t) for t in texts]


def test_replay_of_long_words(tik):
    """Words of many thousand letters, as data or scripts without spaces have: no step a letter."""
    rng = np.random.default_rng(4)
    codec = bpe.Codec.of(queries.MULTI_RANKS, public_tokenizers.PATTERN)
    texts = ["a" * 40_001, "ab" * 30_000, "".join(map(chr, rng.integers(97, 123, 60_000))), "漢字仮名" * 5_000, " =" * 3 + "=" * 20_001, "x" * 5 + "\n" * 300]
    ids = codec.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [tik.encode_ordinary(t) for t in texts]
    assert codec.decode(ids).to_pylist() == [t.encode() for t in texts]


def test_line_dedup(spark, root):
    docs, held, want = documents(spark, root), {}, {}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(i)
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        want[i] = (len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept)))
    assert got(spark, "op8_line_dedup", root)[0] == want
    assert root != "awkward" or any(x[1] for x in want.values())
    out = line_dedup.line_dedup(spark.read.parquet(f"{root}/documents.parquet"), batches=7, fanout=2)
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept_text)) for r in out.collect()} == want


def test_line_dedup_counts_documents(spark):
    """Four documents hold the line, in five rows: it stays. A fifth document, and all but the largest id's rows lose it."""
    line = "a line of more than forty characters, which is a key"
    rows = [(1, line), (2, line), (3, line), (4, line), (4, line + "\nmore"), (None, line)]
    for more, want in ([], set()), ([(9, line), (9, "x\n" + line)], {1, 2, 3, 4}):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        for batches, fanout in ((None, 3), (3, 2)):
            out = line_dedup.line_dedup(docs, batches=batches, fanout=fanout).collect()
            assert {r.doc_id for r in out if r.n_dropped} == want and len(out) == len(rows + more)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("kinmark_run")] == []


def test_line_dedup_of_a_hot_line(spark, monkeypatch):
    """Keys over the share of 1 / HOT take the other way; results don't differ."""
    lines = [f"{'line ' * 8} number {i} of some more" for i in range(6)]
    docs = spark.createDataFrame([(i, "\n".join(lines[: 1 + i % 6])) for i in range(40)], "doc_id long, text string")
    want = sorted(line_dedup.line_dedup(docs).collect())
    for hot in (1, 4, 10**9):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert sorted(line_dedup.line_dedup(docs).collect()) == want


def test_columns_in_passing_never_clash(spark):
    names = ["key", "at", "place", "id", "gone", "may", "lines", "kept", "n", "slot_", "kept_text"]
    docs = spark.createDataFrame([(1, "x\ny", *names)], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)]))
    out = sharding.assign_shards(docs).first()
    assert all(out[n] == n for n in names) and out.shard is not None
    gone = spark.createDataFrame([], "doc_id long, gone array<binary>")
    out = line_dedup.without_lines(docs, gone, "doc_id", "text").first()
    assert all(out[n] == n for n in names if n != "kept_text") and out.kept_text == "x\ny"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<article><h1>A &amp; B</h1><p>First&nbsp;part of <b>the</b>
 text<br>goes on.<p>Of.<div class="share-buttons"><p>Share</p></div><ul><li>Item &lt;1&gt;</li></ul>
<form><input name=q><p>Search</p></form><p title="a > b">Last.</article>
<section id="comments"><p>Nice the of and to post it is a long comment of a reader, that is in the page as well as others.</p></section>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html():
    assert html_extract.main_text(PAGE) == "A & B\n\nFirst part of the text goes on.\n\nOf.\n\nItem <1>\n\nLast."
    long = "The cat is in the house and the dog is on the mat, as it was in the days of old when all of them were at home by the sea."
    plain = f"<body><div>Menu</div><div><a href=a>{long}</a></div><p>{long}</p><p>Yes.</p><p>{long}</p><div><a href=x>next page of this</a></div></body>"
    assert html_extract.main_text(plain) == f"{long}\n\nYes.\n\n{long}"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x</nav>") == ""
    assert html_extract.main_text("<p>x") == "x" and html_extract.main_text("a < b") == "a < b"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<video-player src='a'></video-player><p>Text</p>", "Text"),
        ("<button-group>A</button-group><p>Text</p>", "A\n\nText"),
        ("<svg class='x'/><p>Text</p>", "Text"),
        ("<p>In <svg viewBox='0'><title/><path d='M0'/><text>no</text></svg>line</p>", "In line"),
        ("<div><button>Go</div><p>Text</p>", "Go\n\nText"),
        ("<button>A<p>Text</p><button>no</button><p>More</p>", "A\n\nText\n\nMore"),
        ("<p>Take <select><option>no<option>no</select>one</p>", "Take one"),
        ("<video src=a><p>Text</p>", "Text"),
        ("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> has it</p>", "As x=2 has it"),
        ("<object data=a>no</object><p>Text</p><script>no", "Text"),
        ("<p>Text</p><noscript><p>no</p></noscript><iframe src=a></iframe><p>More</p>", "Text\n\nMore"),
        ("<titlebar>A</titlebar><p>Text</p>", "A\n\nText"),
    ],
)
def test_html_keeps_text_behind_media_and_controls(page, want):
    assert html_extract.main_text(page) == want


def test_html_query(spark, sf, awkward):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for i, (_, text, n) in got(spark, "op9_html", sf)[0].items():
        article = re.search(r"<article>(.*?)</article>", pages[i], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert text == "\n\n".join(x for x in blocks if x) and n == len(text)
    assert got(spark, "op9_html", awkward)[0] == {1: (None, "", 0), 2: ("u", "", 0), 3: ("u", "x", 1)}


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    rows = [r for r in queries.op10_toxicity(spark, root).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hit = sum(r.predicted == labels[r.doc_id] == 1 for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(labels[r.doc_id] for r in rows) > 0.85


def test_machine_learns_pairs():
    """A label that only a pair of features tells: a linear model can't pass 3 in 4."""
    rng = np.random.default_rng(0)
    on = rng.random((4000, 2)) < 0.5
    label = (on[:, 0] == on[:, 1]).astype(float)
    row, col = np.nonzero(on)
    model = toxicity.Model(np.arange(1), 0.0, np.zeros(2), rng.normal(0, 0.3, (2, 4)))
    toxicity.train(model, row, col, label, epochs=40)
    assert ((model.margin(4000, row, col) > 0) == label).mean() > 0.95


def test_margin_by_the_sum_over_pairs():
    """The machine's score against bias + weights + every pair of features, one by one."""
    rng = np.random.default_rng(2)
    model = toxicity.Model(np.arange(10), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    sets = [sorted(rng.choice(20, int(rng.integers(0, 9)), replace=False).tolist()) for _ in range(30)]
    want = []
    for features in sets:
        total = 0.3 + sum(model.weight[i] for i in features)
        total += sum(float(model.factor[i] @ model.factor[j]) for k, i in enumerate(features) for j in features[:k])
        want.append(total)
    row, feature = (np.array(x, int) for x in zip(*[(r, f) for r, fs in enumerate(sets) for f in fs], strict=True))
    assert model.margin(30, row, feature) == pytest.approx(want)


def test_toxicity_awkward(spark, awkward):
    found, rows = got(spark, "op10_toxicity", awkward)
    assert len(rows) == len(awkward_rows()) and all(0 <= x[1] <= 1 for x in found.values())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty, name):
    df = queries.queries()[name](spark, empty)
    assert df.collect() == [] and df.columns


def test_repeated_and_null_ids(spark, tmp_path, awkward):
    """Repeated rows and null ids give a row each, without a crash, and other rows' results don't move."""
    docs = spark.read.parquet(f"{awkward}/documents.parquet").select("doc_id", "text")
    docs.union(docs.filter("doc_id in (1, 2, 4, 8)")).union(spark.createDataFrame([(None, "x"), (None, None), (None, "w1 " * 60)], "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{awkward}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    n = docs.count()
    for name, q in queries.queries().items():
        if name == "op9_html":
            continue
        rows = q(spark, str(tmp_path)).collect()
        assert len(rows) == n + 7, name
        if name in ("op1_substring_dedup", "op2_simhash", "op3_sharding", "op4_decontamination", "op7_bpe", "op8_line_dedup"):
            assert {r[0]: tuple(r[1:]) for r in rows if r[0] is not None} == got(spark, name, awkward)[0], name


def test_bpe_decode_alone(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    encoded = bpe.encode(docs, queries.MULTI_RANKS, public_tokenizers.PATTERN, decoded=True)
    both = bpe.decode(encoded, queries.MULTI_RANKS, public_tokenizers.PATTERN, out_col="again")
    assert both.count() == both.filter("decoded = again").count() == docs.count()
