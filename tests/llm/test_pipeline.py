"""The pipeline against the operators' brute-force versions, stage by stage."""

import hashlib

import corpus_pipeline
from kinmark.llm import queries

from .test_operators import brute_decontam, brute_simhash, documents, lower


def test_pipeline(spark, tmp_path):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, before, outs = docs.columns, docs, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}/documents.parquet")
        outs[name] = before, docs
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    scores = {r.doc_id: r.predicted for r in queries.op10_toxicity(spark, root).collect()}
    first, kept = outs["toxicity"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in first.collect() if not scores[r.doc_id]}
    texts = dict(documents(spark, f"{tmp_path}/1"))
    held = {}
    for i, t in documents(spark, f"{tmp_path}/0"):
        for k in {lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add(i)
    for i, t in documents(spark, f"{tmp_path}/0"):
        keys = [(x, held.get(lower(x.strip(" \t\n\x0b\x0c\r")), ())) for x in (t or "").split("\n")]
        assert texts[i] == "\n".join(x for x, k in keys if len(k) < 5 or max(k) == i)
    classes = brute_simhash(list(texts.items()))
    left = dict(documents(spark, f"{tmp_path}/2"))
    assert set(left) == {i for i, (_, c) in classes.items() if i == c}
    hits = brute_decontam(list(left.items()), [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()])
    clean = dict(documents(spark, f"{tmp_path}/3"))
    assert set(clean) == {i for i, x in hits.items() if not x[4]} and len(clean) < len(left)
    assert {r.doc_id for r in outs["byte_bpe"][1].collect()} == set(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, root).collect())) == sorted(map(tuple, outs["byte_bpe"][1].collect()))


def test_pipeline_returns_tokens(spark):
    """The last stage holds each document's ids, little-endian uint32, beside their hash."""
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    found = corpus_pipeline.tokenise(spark, docs, root)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in found.collect():
        assert len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256


def awkward_folder(spark, path, rows, names=("key", "id", "h", "kept_text", "n_lines", "score")):
    docs = spark.createDataFrame([(*r, *names) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"{n} string" for n in names)]))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12))), (None, "nameless passage here"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs.columns


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Null columns, empty, very long and repeated texts, repeated and null ids, names that the stages use themselves."""
    line = "this line is repeated and it has over forty characters"
    passage = " ".join(f"b{i}" for i in range(12))
    words = lambda a, n: " ".join(f"{a}{i * i % 997}" for i in range(n))
    rows = [(1, None), (2, ""), (3, words("x", 300)), (4, words("x", 300)), (5, f"{words('y', 40)} {passage} end"), (6, f"a nameless passage here {words('z', 50)}")]
    rows += [(10 + i, f"{line}\n{words(chr(97 + i), 60)}") for i in range(6)] + [(30, words("q", 80)), (30, words("q", 80)), (30, words("r", 80))]
    rows += [(None, words("s", 70)), (None, None), (None, f"{line} {passage}"), (40, "word " * 60_000)]
    columns = awkward_folder(spark, tmp_path, [(*r, None, None, None) for r in rows])
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.select("doc_id").collect()))
        assert name == "byte_bpe" or docs.columns == columns
    every = sorted(i if i is not None else -1 for i, _ in rows)
    assert kept[0] == every and kept[1] == every  # no labels to speak of: all stay; lines go, documents don't
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/line_dedup").filter("doc_id between 10 and 15").collect()}
    assert [line in texts[10 + i] for i in range(6)] == [False] * 5 + [True]
    assert {2, 4}.isdisjoint(kept[2]) and {1, 3} <= set(kept[2]) and kept[2].count(30) == 3 and kept[2].count(-1) == 3
    assert {5, 6}.isdisjoint(kept[3]) and kept[3].count(-1) == 2 and set(kept[3]) | {5, 6} == set(kept[2]) and kept[4] == kept[3]
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == kept[4]


def test_pipeline_of_empty_tables(spark, tmp_path):
    awkward_folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
