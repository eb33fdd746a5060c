"""Goldens of the pair scores, and the kernels against plain versions."""

import math
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from kinmark.functions import code as K
from kinmark.functions import kernels, sql
from kinmark.functions import text as T
from kinmark.functions.lexicon import STOP_WORDS, tfidf_stop_words
from kinmark.operators import candidates, semantic, service, similarity
from kinmark.plans import catalogue
from kinmark.sources import files, ingest
from kinmark.streaming import jobs

PAIRS = [
    (1, "Plagiarism detection system compares documents.", "Document similarity system detects plagiarism."),
    (2, "Plagiarism detection system", "Plagiarism detection system"),
    (3, "football is a popular sport", "machine learning models detect fraud"),
    (4, "the of", ""),
]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def words(*x):
    return F.array(*[F.lit(w) for w in x]).cast("array<string>")


def test_word_lists():
    assert len(STOP_WORDS) == 179 and len(tfidf_stop_words()) == 318


def test_clean_and_tokens(spark):
    row = one(spark, T.clean_text(F.lit("Café  don't\n STOP—now")), T.without_stop_words(T.tokens(T.clean_text(F.lit("This is a Sample text, for Testing!!!")))), T.tokens(F.lit("")))
    assert list(row) == ["caf don't stop now", ["sample", "text", "testing"], []]


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 1.0), ("abc", "ade", 0.2), ("xy", "ab", 0.0), ("", "", 1.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, T.jaccard(words(*a), words(*b)))[0] == want


def test_text_report(spark):
    rows = {r.pair_id: r for r in similarity.compare_texts(spark.createDataFrame(PAIRS, "pair_id long, text_a string, text_b string")).collect()}
    assert (rows[1].jaccard, rows[1].lcs, rows[1].cosine, rows[1].final_similarity, rows[1].risk_level) == (0.25, 0.2, 0.1684, 0.191, "LOW")
    assert (rows[2].jaccard, rows[2].lcs, rows[2].cosine, rows[2].final_similarity, rows[2].risk_level) == (1, 1, 1, 1, "HIGH")
    assert rows[3].final_similarity == 0 and rows[4].error == "empty vocabulary" and rows[4].final_similarity is None
    assert math.isclose(T.KAPPA, math.log(1.5) + 1)


def test_risk(spark):
    assert list(one(spark, *[T.risk(F.lit(x)) for x in (0.0, 0.2999, 0.3, 0.4999, 0.5, 1.0)])) == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j + 1] + 1 if x == y else max(row[j + 2], new[-1]))
        row = new
    return row[-1]


def test_lcs_kernel():
    random.seed(1)
    for _ in range(200):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 30))] for _ in range(2))
        assert kernels.lcs_length(a, b) == plain_lcs(a, b) == kernels.lcs_length(b, a)


def test_lcs_scores(spark):
    row = one(spark, kernels.text_lcs(words(), words()), kernels.code_lcs(words(), words()), kernels.code_lcs(words(), words("a")), kernels.text_lcs(words("a", "b"), words("b")))
    assert list(row) == [0.0, 1.0, 0.0, 1.0]


def test_code_lcs_of_whole_lists(spark):
    x, y = (F.concat(F.array_repeat(F.lit(t), 8000), F.array_repeat(F.lit("c"), 2000)) for t in "ab")
    assert list(one(spark, kernels.code_lcs(x, y), kernels.code_lcs(x, y, 8000))) == [0.2, 0]


def test_lexers(spark):
    tok = lambda c, lang: K.tokenize(K.clean_code(F.lit(c), F.lit(lang)), F.lit(lang))
    row = one(spark, tok('a<=b->c::d && 12.5 "x y"', "cpp"), kernels.code_columns(F.lit("def add(a, b): return a + b"), F.lit("python"), "words")["words"], K.clean_code(F.lit("a # x\rb\nc"), F.lit("python")), K.clean_code(F.lit("a /* b\n c */ d // e\nf"), F.lit("java")))
    assert row[0] == "a <= b -> c :: d && 12 . 5 x y".split() and row[1] == "def var1 ( var2 , var3 ) return var2 + var3".split()
    assert row[2] == "a c" and row[3] == "a d f"


def test_language(spark):
    assert list(one(spark, *[K.detect_language(F.lit(x)) for x in ("", "#include <iostream>", "public class A { }")])) == ["python", "cpp", "java"]


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "a", 0.0), ("a b", "b c d e", 0.2), ("a bc d", "ab c d", 1.0)])
def test_winnowing(spark, a, b, want):
    x, y = words(*a.split()), words(*b.split())
    prints = lambda w: K.winnow(K.hashes(K.kgrams(w)))
    assert one(spark, K.winnow_similarity(x, y, prints(x), prints(y)))[0] == want


@pytest.mark.parametrize(("other", "winnowing", "lcs", "ngrams", "types"), [("sum", 0.2, 0.7143, 0.3889, 0.8182), ("multiply", 0.3333, 0.9091, 0.5385, 0.8), ("loop", 0.0, 0.2727, 0.0, 0.2143)])
def test_code_goldens(spark, other, winnowing, lcs, ngrams, types):
    docs = spark.createDataFrame([(1, catalogue.CODE["add"]), (2, catalogue.CODE[other])], "doc_id long, text string")
    r = similarity.code_report(similarity.neighbours(docs), similarity.prepare_code(docs)).first()
    assert (r.winnowing, r.lcs, r.ast) == (winnowing, lcs, ngrams)
    row = catalogue.ast_ngram_jaccard(spark, None).filter((F.col("a") == "add") & (F.col("b") == other)).first()
    assert (row.ngrams, row.types) == (ngrams, types)


def test_kernels_agree_with_built_ins(spark, sf):
    """The kernels of programs and texts against the built-in columns, on whole documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = kernels.code_columns(F.col("text"), F.lit("cpp"), "words", "digests", "prints")
    rows = docs.select(c.alias("c"), K.tokenize(K.clean_code(F.col("text"), F.lit("cpp")), F.lit("cpp")).alias("t"))
    rows = rows.select("c.*", "t").select("*", K.hashes(K.kgrams(F.col("words"))).alias("h"), K.winnow(F.col("digests")).alias("p"))
    assert rows.filter("size(words) <> size(t) or digests <> h or prints <> p").count() == 0
    for r in rows.limit(20).collect():
        names = {}
        assert all(w == t or names.setdefault(t, w) == w for w, t in zip(r["words"], r["t"], strict=True))
        assert list(names.values()) == [f"var{i + 1}" for i in range(len(names))]


def test_digits_of_any_script(spark):
    assert one(spark, K.tokenize(F.lit("x٣٤ + 12"), F.lit("python")))[0] == ["x", "٣٤", "+", "12"] == kernels.LEX["python"].findall("x٣٤ + 12")


def test_lemma_table(spark):
    lemmas = spark.createDataFrame([("compares", "compare"), ("cats", "cat"), (None, "x")], "word string, lemma string")
    pairs = spark.createDataFrame([(1, "cats compares rivers", "cat compare river")], "pair_id long, text_a string, text_b string")
    docs = pairs.selectExpr("0L AS doc_id", "text_a AS text").union(pairs.selectExpr("1L", "text_b"))
    score = lambda x: similarity.tfidf_cosine(similarity.neighbours(docs), similarity.prepare_text(docs), x).first().cosine
    assert score({}) == 0 < score(lemmas) < 1 and score({"rivers": "river"} | similarity.lemma_table(lemmas)) == pytest.approx(1)
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError):
        m.setattr(similarity, "MOST_LEMMAS", 1)
        similarity.lemma_table(lemmas)


def test_fusion(spark):
    assert list(one(spark, T.rounded(T.fused_code(F.lit(0.5), F.lit(0.4), F.lit(0.2))), T.rounded(T.fused_code(F.lit(0.5), F.lit(0.4), F.lit(None).cast("double"))))) == [0.38, 0.42]


def test_unified(spark):
    rows = [(1, "code", "def add(a,b): return a+b", "def add(x,y): return x+y"), (2, "text", "  \n", "x"), (3, "image", "a", "b"), (4, "text", *PAIRS[1][1:])]
    got = {r.pair_id: r for r in similarity.unified_report(spark.createDataFrame(rows, "pair_id long, mode string, text_a string, text_b string")).collect()}
    assert (got[1].scores.winnowing, got[1].scores.lcs, got[1].scores.ast, got[1].final_similarity, got[1].risk_level, got[1].language) == (1, 1, 1, 1, "HIGH", "python")
    assert got[2].error == "content is empty" and got[3].error == "unknown mode" and got[4].language == "english"


def lined(names, first=1, each=2):
    """Tokens, `each` a line."""
    return [(t, first + i // each) for i, t in enumerate(names.split())]


def test_alignment_goldens():
    p, q, r = "p1 p2 p3 p4 p5 p6", "q1 q2 q3 q4 q5 q6", "r1 r2 r3 r4 r5 r6"
    block = lambda score, a, b: {"score": score, "file_a_region": a, "file_b_region": b}
    assert kernels.align(lined(p), lined(p)) == [block(100, [1, 3], [1, 3])]
    assert kernels.align(lined(p), lined(f"x y z w {p}")) == [block(100, [1, 3], [3, 5])]
    assert kernels.align(lined(f"{p} {q}"), lined(f"{r} {q}")) == [block(50, [4, 6], [4, 6])]
    # both parts, the other way round: the first of two equal maxima by rows comes first
    assert kernels.align(lined(f"{p} {q}"), lined(f"{q} {p}")) == [block(50, [1, 3], [4, 6]), block(50, [4, 6], [1, 3])]
    # two lines are too few; 2 points of 40 are too few
    assert kernels.align(lined("p1 p2 p3 p4"), lined("p1 p2 p3 p4")) == []
    assert kernels.align(lined("a " + "x " * 19), lined("a " + "y " * 19)) == []
    # a token too many inside costs one: 6 * 2 - 1 of 2 * 6
    assert kernels.align(lined(p), lined("p1 p2 p3 z p4 p5 p6")) == [block(91.67, [1, 3], [1, 4])]
    assert kernels.align([], lined(p)) == kernels.align(lined(p), []) == []


def test_alignment_properties():
    random.seed(4)
    for _ in range(80):
        a, b = ([(random.choice("abcde"), i // 3) for i in range(random.randint(1, 60))] for _ in range(2))
        found = kernels.align(a, b)
        assert len(found) <= 10 and kernels.align(a, b, cap=10**6) == found
        for x in found:
            assert 15 <= x["score"] <= 100
            for side, (lo, hi) in ((a, x["file_a_region"]), (b, x["file_b_region"])):
                assert hi - lo >= 2 and lo >= 0 and hi <= side[-1][1]
        assert kernels.align(a, a)[:1] == ([{"score": 100, "file_a_region": [0, a[-1][1]], "file_b_region": [0, a[-1][1]]}] if a[-1][1] >= 2 else [])


def test_alignment_of_whole_texts():
    """The only common stretch lies behind 8000 tokens."""
    a, b = ([(f"{x}{i % 50}", i // 10) for i in range(8100)] for x in "ab")
    tail = [(f"t{i}", 900 + i // 10) for i in range(2000)]
    assert [x["file_a_region"] for x in kernels.align(a + tail, b[:50] + tail)] == [[900, 1099]]
    assert kernels.align(a + tail, b[:50] + tail, cap=8000) == []


def test_code_queries_cover_documents(spark, tmp_path):
    rows = [(1, catalogue.CODE["add"]), (2, catalogue.CODE["multiply"]), (3, catalogue.CODE["long_one"]), (4, catalogue.CODE["long_one"]), (5, "no code, this"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.pair_id: r for r in catalogue.ast_ngram_jaccard(spark, str(tmp_path)).collect()}
    assert sorted(found) == [1, 2, 3, 4] and (found[1].ngrams, found[1].types) == (0.5385, 0.8) and found[3].ngrams == 1 and found[4].ngrams == 0
    edits = {r.pair_id: r.likeness for r in catalogue.ast_node_edit_similarity(spark, str(tmp_path)).collect()}
    assert (edits[1], edits[3], edits[4]) == (0.9167, 1, 0)
    assert [(r.pair_id, r.score, r.file_a_region) for r in catalogue.local_alignment_blocks(spark, str(tmp_path)).filter("pair_id = 3").collect()] == [(3, 100, [1, 5])]
    golden = {(r.a, r.b): r.likeness for r in catalogue.ast_node_edit_similarity(spark, None).collect()}
    assert [golden["add", x] for x in ("sum", "multiply", "loop")] == [0.6471, 0.9167, 0.2857]


def test_near_duplicates(spark):
    random.seed(2)
    base = [random.choice("abcdefghijklmnop") + str(random.randint(0, 50)) for _ in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:-3], "x"])), (4, "quite another text with words of its own"), (5, None)]
    out = {r.doc_id: (r.class_id, r.n_links) for r in candidates.near_duplicates(candidates.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (5, 0)}


def test_near_duplicates_by_all_shingles(spark, monkeypatch):
    """Copies with a few replaced words: every link of plain shingle sets, with its similarity, and no other."""
    rng = random.Random(5)
    rows = []
    for i in range(20):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 160))]
        rows.append((4 * i, " ".join(base)))
        for j in range(1, 4):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randint(1, 4)):
                copy[at] = "new"
            rows.append((4 * i + j, " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] != sets[b]}
    want = {k: x for k, x in want.items() if x >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for frequent in (candidates.FREQUENT, 1):  # with 1, all shingles of a prefix are put last
        monkeypatch.setattr(candidates, "FREQUENT", frequent)
        found = {(r.id_a, r.id_b): r.similarity for r in candidates.near_duplicate_links(candidates.shingle_sets(docs)).collect()}
        assert found == want and len(want) > 20


def test_short_texts_share_a_class_only_if_equal(spark):
    texts = ["Hello there", "hello, THERE!", "other words", "", None, "...", "你好世界", "你好朋友", "你好世界", "Москва online", "Париж online", "a b c d e", "a b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.class_id, r.n_links) for r in candidates.near_duplicates(candidates.shingle_sets(docs)).collect()}
    assert out == {i: (c, 0) for i, c in enumerate([0, 0, 2, 3, 3, 5, 6, 7, 6, 9, 10, 11, 12])}


def test_topk_in_blocks(spark, sf, monkeypatch):
    whole = sorted(map(tuple, semantic.cosine_topk(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()))
    monkeypatch.setattr(semantic, "BLOCK", 2)
    monkeypatch.setattr(semantic, "CHUNK", 9)
    assert sorted(map(tuple, semantic.cosine_topk(spark.read.parquet(f"{sf}/embeddings.parquet")).collect())) == whole


def test_history_pages(spark):
    subs = spark.createDataFrame([(i, 1, "text", f"2024-01-{i:02d}") for i in range(1, 18)], "id long, user_id long, mode string, created_at string")
    reps = spark.createDataFrame([(1, 0.9, "HIGH", "english")], "submission_id long, final_similarity double, risk_level string, language string")
    assert [r.id for r in service.page(service.history(subs, reps, 1), 3).collect()] == [1]
    assert service.history_count(subs, reps).first() == (17, 3) and service.history_count(subs, reps, risk="HIGH").first() == (1, 1)
    assert service.history_count(subs, reps, risk="bogus").first()[0] == 17


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("né".encode("latin-1"))
    (tmp_path / "b.TXT").write_text("né")
    (tmp_path / "c.py").write_text("x")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files._W[1:-1]}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "e.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path), "text").collect()}
    assert got == {"a.txt": ("né", None), "b.TXT": ("né", None), "d.docx": ("One\nTwo", None), "e.docx": (None, "cannot extract text")}


def test_streams_agree_with_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    job = jobs.quota_stream(stream, "400 days").writeStream.format("memory").queryName("quota").outputMode("update").trigger(availableNow=True).start()
    job.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT user_id, day, n, blocked FROM quota").collect()}
    want = {tuple(r) for r in service.daily_quota(events.withColumnRenamed("ts", "created_at")).collect()}
    assert want <= got


def test_rate_stream_and_once(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", F.monotonically_increasing_id().alias("event"))
    events.unionByName(events).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    single = jobs.once(stream, "event", late="4000 days")
    single.writeStream.format("memory").queryName("single").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("single").count() == events.count()
    jobs.rate_stream(stream, "4000 days").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT user_id, start, n, over FROM rates").collect()}
    assert got == {tuple(r) for r in service.rate_windows(events.unionByName(events)).collect()}


def test_analysis_job(spark, tmp_path):
    rows = [*[(p, "text", a, b) for p, a, b in PAIRS[:2]], (1, *("text", *PAIRS[0][1:])), (9, "text", " ", "x")]
    spark.createDataFrame(rows, "pair_id long, mode string, text_a string, text_b string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("pair_id long, mode string, text_a string, text_b string").json(f"{tmp_path}/in")
    jobs.analysis_job(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.pair_id: r.risk_level for r in out} == {1: "LOW", 2: "HIGH", 9: None} and len(out) == 3
    assert all(r.processing_time_ms > 0 and r.algorithm_version == "1.0.0" for r in out)
    states = service.latest_status(spark.read.parquet(f"{tmp_path}/out-status"))
    assert {r.submission_id: r.message for r in states.collect()} == {1: "Analysis complete. Your report is ready.", 2: "Analysis complete. Your report is ready.", 9: "Analysis failed: content is empty"}


def test_files_to_submissions(spark, tmp_path):
    (tmp_path / "a.py").write_text("def add(a, b):\n    return a + b")
    (tmp_path / "b.py").write_text("def plus(x, y):\n    return x + y")
    found = files.read_files(spark, str(tmp_path), "code")
    paths = sorted(r.path for r in found.collect())
    pairs = spark.createDataFrame([(1, "code", *paths), (2, "code", paths[0], "none")], "pair_id long, mode string, path_a string, path_b string")
    out = {r.pair_id: r for r in similarity.unified_report(jobs.file_submissions(pairs, found)).collect()}
    assert out[1].final_similarity == 1 and out[2].error == "content is empty"


def test_write_objects(spark, tmp_path):
    rows = [(1, "a/b.txt", b"one"), (1, "c.txt", b"x" * 50), (2, "c.txt", b"two")]
    out = files.write_objects(spark.createDataFrame(rows, "user_id long, name string, content binary"), f"{tmp_path}/store", max_bytes=10)
    got = {(r.user_id, r.name): (r.key, r.error) for r in out.collect()}
    assert got[1, "c.txt"] == (None, "file too large") and got[1, "a/b.txt"][0].startswith("users/1/") and got[1, "a/b.txt"][0].endswith("_a_b.txt")
    assert {(r.key, bytes(r.content)) for r in spark.read.parquet(f"{tmp_path}/store").collect()} == {(got[1, "a/b.txt"][0], b"one"), (got[2, "c.txt"][0], b"two")}


def test_ingest(spark, tmp_path):
    """Checks in their order, files, rows and states of what is accepted, and the analysis of it."""
    users = spark.createDataFrame([(1, "free"), (2, "pro")], "id long, plan string")
    before = spark.createDataFrame([(1, "2024-05-01 08:00:00")] * 3, "user_id long, created_at string")
    text, code = b"some words of a text", b"def f(x):\n    return x"
    rows = [(i, u, m, n1, c1, n2, c2, f"2024-05-01 10:00:0{i}") for i, (u, m, n1, c1, n2, c2) in enumerate([
        (1, "text", "a.txt", text, "b.TXT", text), (1, "image", "a.txt", text, "b.txt", text), (1, "code", "a.py", code, "b.txt", text),
        (1, "code", "a.py", code, "b.py", code), (2, "code", "x/a.py", code, "b.py", b"y" * 11_000_000), (2, "code", "x/a.py", code, ".py", code), (2, "code", "x/a.py", code, "b.py", code)])]
    uploads = spark.createDataFrame(rows, "id long, user_id long, mode string, name1 string, content1 binary, name2 string, content2 binary, created_at string")
    uploads, before = (d.withColumn("created_at", F.col("created_at").cast("timestamp")) for d in (uploads, before))
    out = {r.id: (r.code, r.error) for r in ingest.ingest(uploads, before, users, f"{tmp_path}/in").collect()}
    assert out == {0: (None, None), 1: (422, "unknown mode"), 2: (422, "file type not allowed"), 3: (429, "daily limit reached"), 4: (413, "file too large"), 5: (422, "file type not allowed"), 6: (None, None)}
    subs = spark.read.parquet(f"{tmp_path}/in/submissions")
    objects = spark.read.parquet(f"{tmp_path}/in/objects").select(F.col("key").alias("path"), F.col("content").cast("string").alias("text"))
    pairs = subs.select(F.col("id").alias("pair_id"), "mode", F.col("file1_path").alias("path_a"), F.col("file2_path").alias("path_b"))
    reports = similarity.unified_report(jobs.file_submissions(pairs, objects)).collect()
    assert {r.pair_id: r.final_similarity for r in reports} == {0: 1.0, 6: 1.0}
    assert {(r.submission_id, r.status) for r in spark.read.parquet(f"{tmp_path}/in/status").collect()} == {(0, "pending"), (6, "pending")}


def test_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "id long, score double")
    for kind in ("parquet", "json"):
        files.write_reports(rows, f"{tmp_path}/{kind}", kind)
        files.write_reports(rows.limit(1), f"{tmp_path}/{kind}", kind)
        got = spark.read.format(kind).schema(rows.schema).load(f"{tmp_path}/{kind}")
        assert got.count() == 3 and got.filter("id = 2 and score is null").count() == 1


def test_database_table(spark, tmp_path):
    """Through the database that comes with Spark; written and read in parallel by a range of ids."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(20).selectExpr("id", "concat('s', id) AS name").write.jdbc(url, "submissions", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    got = files.read_table(spark, url, "submissions", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", partitionColumn="id", lowerBound="0", upperBound="20", numPartitions="4")
    assert got.rdd.getNumPartitions() == 4 and [tuple(r) for r in got.filter("id >= 18").orderBy("id").collect()] == [(18, "s18"), (19, "s19")]


def test_extensions(spark):
    names = {"a.py": ".py", ".py": "", "x/.py": "", "a.b.TXT": ".txt", "..py": "", "..a.py": ".py", "a": "", "a.": ".", "x.y/a": "", "a..c": ".c"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", service.extension(F.col("n")).alias("e")).collect()
    assert {r.n: r.e for r in rows} == names


def test_status_machine(spark):
    current = spark.createDataFrame([(1, "pending"), (2, "processing"), (3, "completed"), (4, "processing")], "submission_id long, status string")
    changes = spark.createDataFrame([(1, "processing", None, 1), (1, "completed", None, 1), (2, "failed", "e" * 2000, 1), (3, "failed", "x", 1), (4, "completed", "left", 1), (5, "pending", None, 1), (6, "failed", None, 1)], "submission_id long, status string, error_message string, ts long")
    got = {(r.submission_id, r.status): r.error_message for r in service.status_events(changes, current).collect()}
    assert got == {(1, "processing"): None, (2, "failed"): "e" * 1024, (4, "completed"): None, (5, "pending"): None}


def test_page_span(spark):
    spans = [tuple(one(spark, service.page_span(F.lit(t), F.lit(n)))[0]) for t, n in ((0, 1), (17, 3), (17, 9), (17, 0), (16, 2))]
    assert spans == [(1, 0, 0), (3, 17, 17), (3, 17, 17), (1, 1, 8), (2, 9, 16)]


def test_node_sequences(spark):
    """Nodes of any names; an option takes the first ones only."""
    assert kernels.node_chars(["x", "y", "x"])[0] == kernels.node_chars(["x"]) != kernels.node_chars(["y"]) and kernels.node_chars(None) is None
    rows = [(["a", "b", "c"], ["a", "x", "c"]), ([], []), (["a"], []), (["a"] * 9000, ["a"] * 8000 + ["b"] * 1000)]
    nodes = spark.createDataFrame(rows, "a array<string>, b array<string>")
    likeness = lambda cap: [round(r[0], 4) for r in nodes.select(similarity.sequence_likeness(F.col("a"), F.col("b"), cap)).collect()]
    assert likeness(None) == [0.6667, 1.0, 0.0, 0.8889] and likeness(kernels.CAP) == [0.6667, 1.0, 0.0, 1.0]


def test_sql_functions(spark):
    assert {"jaccard_similarity", "lcs_similarity", "winnowing_similarity", "ngram_jaccard", "local_alignment"} <= set(sql.register(spark))
    row = spark.sql("""SELECT jaccard_similarity(array('a', 'b'), array('b', 'c')), lcs_similarity(array('a', 'b'), array('b')), code_lcs_similarity(array('a', 'b'), array('b')),
        winnowing_similarity(code_words('def add(a, b): return a + b', 'python'), code_words('def plus(x, y): return x + y', 'Python')), ngram_jaccard(ast_nodes('x = 1', 'python'), ast_nodes('y = 2', 'python')),
        edit_similarity('abc', 'abd'), cosine_similarity(array(1f, 0f), array(0f, 1f)), local_alignment('a\nb\nc', 'a\nb\nc', 'python')[0].score""").first()
    assert [round(x, 4) for x in row] == [0.3333, 1, 0.5, 1, 1, 0.6667, 0, 100]


def check_joins(spark, sf, name):
    """No table of a query is broadcast, however small its files, and its rows are those of the SQL."""
    out = catalogue.queries()[name](spark, sf)
    rows = out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    duckdb.sql(f"CREATE OR REPLACE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    assert sorted(map(tuple, rows)) == sorted(duckdb.sql(catalogue.oracle_sql()[name]).fetchall())


def test_cross_lang_joins(spark, sf):
    check_joins(spark, sf, "part_code_score_cross_lang")


def test_same_lang_joins(spark, sf):
    check_joins(spark, sf, "part_code_score_same_lang")


def test_code_lcs_joins(spark, sf):
    check_joins(spark, sf, "part_code_lcs")
    program = spark.createDataFrame([(1, "x = 1", "python")], "doc_id long, text string, lang string")
    assert similarity.prepare_code(program, lang=F.col("lang"), fields=("words",)).first().asDict() == {"id": 1, "lang": "python", "code": "x = 1", "words": ["var1", "=", "1"]}
