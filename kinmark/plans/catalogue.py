"""The registered queries, and the SQL that each is checked against.

Text and code queries run over whole `documents`; pairs are neighbouring ids. The service's tables are views of the
star schema: an order is a submission, a fulfilled one has a report. Queries with LCS, syntax trees or alignment have no
SQL that ends on whole texts; tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as K
from ..functions import kernels, lexicon, sql
from ..functions import text as T
from ..operators import candidates, semantic, service, similarity
from ..storage import spread

CODE = {
    "add": "def add(a, b):\n    return a + b",
    "add_renamed": "def plus(x, y):\n    return x + y",
    "sum": "def sum(x, y):\n    result = x + y\n    return result",
    "multiply": "def multiply(a, b):\n    return a * b",
    "loop": "for i in range(10):\n    print(i)",
    "long_one": "def f(a):\n    b = a + 1\n    c = b * 2\n    d = c - 3\n    return d\n",
    "long_two": "def g(x):\n    y = x + 1\n    z = y * 2\n    w = z - 3\n    return w\n",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("o_orderpriority") < "3", "code").otherwise("text")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), mode.alias("mode"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.pmod(F.col("o_orderkey") * 37, F.lit(1000)) / 1000
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("submission_id"), score.alias("final_similarity"))
    parts = {f"{s}_score": F.col("final_similarity") if s == "jaccard" else F.lit(None).cast("double") for s in similarity.SCORES}
    return own.withColumns({"risk_level": T.risk(F.col("final_similarity")), "language": F.lit("english"), **parts})


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def code_docs(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    words = K.tokenize(K.clean_code(F.col("text"), F.lit(lang)), F.lit(lang))
    return spread(docs(spark, sf_dir)).select("doc_id", words.alias("words"))


def code_columns(spark: SparkSession, sf_dir: str, *fields: str, lang: str = "python") -> DataFrame:
    """(doc_id, ...) of whole documents read as programs."""
    found = spread(docs(spark, sf_dir)).select("doc_id", kernels.code_columns(F.col("text"), F.lit(lang), *fields).alias("c"))
    return found.select("doc_id", "c.*")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_columns(spark, sf_dir, "words", "prints").withColumnRenamed("doc_id", "id")


def text_clean(spark, sf):
    return clean(spark, sf)


def text_tokens(spark, sf):
    return clean(spark, sf).select("doc_id", F.posexplode(T.tokens(F.col("clean"))).alias("pos", "token"))


def text_stopword_filter(spark, sf):
    kept = T.without_stop_words(T.tokens(F.col("clean")))
    return clean(spark, sf).select("doc_id", F.size(kept).alias("n"), F.array_join(kept, " ").alias("kept"))


def text_jaccard(spark, sf):
    d = docs(spark, sf)
    sides = similarity.with_sides(similarity.neighbours(d), similarity.prepare_text(d), ["words"])
    return sides.select("id_a", "id_b", T.rounded(T.jaccard(F.col("words_a"), F.col("words_b"))).alias("jaccard"))


def text_lcs(spark, sf):
    d = docs(spark, sf)
    return similarity.text_scores(similarity.neighbours(d), similarity.prepare_text(d), "lcs").withColumn("lcs", T.rounded(F.col("lcs")))


def text_tfidf_cosine(spark, sf):
    d = docs(spark, sf)
    return similarity.tfidf_cosine(similarity.neighbours(d), similarity.prepare_text(d)).withColumn("cosine", T.rounded(F.col("cosine")))


def text_report(spark, sf):
    d = docs(spark, sf)
    return similarity.text_report(similarity.neighbours(d), similarity.prepare_text(d))


def risk_classify(spark, sf):
    return reports(spark, sf).select("submission_id", "final_similarity", "risk_level")


def lang_detect(spark, sf):
    return docs(spark, sf).select("doc_id", K.detect_language(F.col("text")).alias("lang"))


def code_clean_python(spark, sf):
    return docs(spark, sf).select("doc_id", K.clean_code(F.col("text"), F.lit("python")).alias("clean"))


def code_clean_c_like(spark, sf):
    return docs(spark, sf).select("doc_id", K.clean_code(F.col("text"), F.lit("java")).alias("clean"))


def _tokens_query(lang):
    return lambda spark, sf: code_docs(spark, sf, lang).select("doc_id", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))


def _normalize_query(lang):
    return lambda spark, sf: code_columns(spark, sf, "words", lang=lang).select("doc_id", F.array_join("words", " ").alias("words"))


def kgram_hash(spark, sf):
    return code_columns(spark, sf, "digests").select("doc_id", F.posexplode("digests").alias("pos", "hash"))


def winnow_fingerprints(spark, sf):
    return code_columns(spark, sf, "prints").select("doc_id", F.explode("prints").alias("fp"))


def winnow_similarity(spark, sf):
    sides = similarity.with_sides(similarity.neighbours(docs(spark, sf)), prints(spark, sf), ["words", "prints"])
    score = K.winnow_similarity(*[F.col(c) for c in ("words_a", "words_b", "prints_a", "prints_b")])
    return sides.select("id_a", "id_b", T.rounded(score).alias("winnowing"))


def code_lcs(spark, sf):
    sides = similarity.with_sides(similarity.neighbours(docs(spark, sf)), prints(spark, sf), ["words"])
    return sides.select("id_a", "id_b", T.rounded(kernels.code_lcs(F.col("words_a"), F.col("words_b"))).alias("lcs"))


def snippet_pairs(spark):
    rows = [(i * 10 + j, a, b, CODE[a], CODE[b]) for i, a in enumerate(CODE) for j, b in enumerate(CODE) if i <= j]
    return spark.createDataFrame(rows, "pair_id long, a string, b string, code_a string, code_b string")


def code_pairs(spark, sf):
    """(pair_id, a, b) of neighbouring documents, named by their ids, and (id, code) of each; without tables, of the snippets."""
    if sf is None:
        rows = snippet_pairs(spark)
        sides = [rows.select((F.col("pair_id") * 2 + i).alias("id"), F.col(f"code_{x}").alias("code")) for i, x in enumerate("ab")]
        return rows.select((F.col("pair_id") * 2).alias("id_a"), (F.col("pair_id") * 2 + 1).alias("id_b"), "pair_id", "a", "b"), sides[0].unionByName(sides[1])
    d = docs(spark, sf)
    pairs = similarity.neighbours(d).select("id_a", "id_b", F.col("id_a").alias("pair_id"), F.col("id_a").cast("string").alias("a"), F.col("id_b").cast("string").alias("b"))
    return pairs, d.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("code"))


def ast_edit_similarity(spark, sf):
    """Source strings stand for sequences that are written one character a node."""
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("a"), F.col("p_brand").alias("b"))
    return pairs.select("key", T.rounded(K.sequence_distance(F.col("a"), F.col("b"))).alias("likeness"))


def _nodes(spark, sf):
    """Pairs with the node sequences na and nb, made once a document."""
    pairs, code = code_pairs(spark, sf)
    nodes = code.select("id", kernels.ast_nodes("code", F.lit("python")).alias("n"))
    return similarity.with_sides(pairs, nodes, ["n"]).withColumnsRenamed({"n_a": "na", "n_b": "nb"})


def ast_ngram_jaccard(spark, sf):
    x, y = F.col("na"), F.col("nb")
    return _nodes(spark, sf).select("pair_id", "a", "b", T.rounded(similarity.ast_likeness(x, y)).alias("ngrams"), T.rounded(similarity.ast_likeness(x, y, 1)).alias("types"))


def ast_node_edit_similarity(spark, sf):
    chars = _nodes(spark, sf).select("pair_id", "a", "b", kernels.ast_chars("na").alias("ca"), kernels.ast_chars("nb").alias("cb"))
    return chars.select("pair_id", "a", "b", T.rounded(similarity.ast_edit_likeness(F.col("ca"), F.col("cb"))).alias("likeness"))


def code_score_same_lang(spark, sf):
    d = docs(spark, sf)
    return similarity.code_report(similarity.neighbours(d), similarity.prepare_code(d, lang=F.lit("python")))


def code_score_cross_lang(spark, sf):
    """Every other document is read as Java, so neighbours differ in language."""
    d = docs(spark, sf)
    lang = F.when(F.pmod("doc_id", F.lit(2)) == 0, "python").otherwise("java")
    return similarity.code_report(similarity.neighbours(d), similarity.prepare_code(d, lang=lang))


def unified_report(spark, sf):
    d = docs(spark, sf)
    both = similarity.neighbours(d).join(d.toDF("id_a", "text_a"), "id_a").join(d.toDF("id_b", "text_b"), "id_b")
    mode = F.when(F.pmod("id_a", F.lit(2)) == 0, "text").otherwise("code")
    return similarity.unified_report(both.select(F.col("id_a").alias("pair_id"), mode.alias("mode"), "text_a", "text_b"))


def part_texts(spark, sf):
    """(doc_id, text): a sentence for each part, short enough for SQL to align word by word."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(" is a "), F.col("p_type"), F.lit(" part of size "), size, F.lit(" and it fits the "), F.col("p_type"), F.lit(" "), F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def part_programs(spark, sf, lang=None):
    """(doc_id, text, lang): a program for each part, in the syntax that Java and C++ share."""
    size, name, brand = F.col("p_size").cast("string"), F.regexp_replace("p_name", " ", "_"), F.regexp_replace("p_brand", "#", "_")
    ends = [F.lit("for (int i = 0; i < size; i++) { total = total + i; } return total;"), F.lit("while (size > 0) { size = size - 1; } return size;"), F.concat(F.lit("return new "), F.col("p_type"), F.lit("(size);"))]
    kind = F.pmod("p_partkey", F.lit(3))
    text = F.concat(F.lit("class "), brand, F.lit(" { int "), name, F.lit("(int size) { if (size > "), size, F.lit(") { return size - "), size, F.lit("; } "), F.when(kind == 0, ends[0]).when(kind == 1, ends[1]).otherwise(ends[2]), F.lit(" } } // "), F.col("p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"), (F.lit("java") if lang is None else lang).alias("lang"))


def part_text_lcs(spark, sf):
    d = part_texts(spark, sf)
    return similarity.text_scores(similarity.neighbours(d), similarity.prepare_text(d), "lcs").withColumn("lcs", T.rounded(F.col("lcs")))


def part_text_report(spark, sf):
    d = part_texts(spark, sf)
    return similarity.text_report(similarity.neighbours(d), similarity.prepare_text(d))


def part_code_lcs(spark, sf):
    d = part_programs(spark, sf)
    sides = similarity.with_sides(similarity.neighbours(d), similarity.prepare_code(d, lang=F.col("lang"), fields=("words",)), ["words"])
    return sides.select("id_a", "id_b", T.rounded(kernels.code_lcs(F.col("words_a"), F.col("words_b"))).alias("lcs"))


def part_code_score_same_lang(spark, sf):
    d = part_programs(spark, sf)
    return similarity.code_report(similarity.neighbours(d), similarity.prepare_code(d, lang=F.col("lang")))


def part_code_score_cross_lang(spark, sf):
    d = part_programs(spark, sf, F.when(F.pmod("p_partkey", F.lit(2)) == 0, "java").otherwise("cpp"))
    return similarity.code_report(similarity.neighbours(d), similarity.prepare_code(d, lang=F.col("lang")))


def part_ast_edit(spark, sf):
    d = part_programs(spark, sf)
    nodes = d.select(F.col("doc_id").alias("id"), kernels.ast_chars(kernels.ast_nodes("text", "lang")).alias("chars"))
    sides = similarity.with_sides(similarity.neighbours(d), nodes, ["chars"])
    return sides.select("id_a", "id_b", T.rounded(similarity.ast_edit_likeness(F.col("chars_a"), F.col("chars_b"))).alias("likeness"))


def part_unified_report(spark, sf):
    """Every mode there is, an unknown one, and blank texts."""
    texts, programs = part_texts(spark, sf), part_programs(spark, sf)
    pairs = similarity.neighbours(texts)
    key = F.col("id_a")
    mode = F.when(F.pmod(key, F.lit(7)) == 3, "image").when(F.pmod(key, F.lit(2)) == 0, "text").otherwise("code")
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("doc_id").alias(f"id_{x}"), F.col("text").alias(f"t_{x}")), f"id_{x}").join(programs.select(F.col("doc_id").alias(f"id_{x}"), F.col("text").alias(f"c_{x}")), f"id_{x}")
    side = lambda x: F.when(F.pmod(key, F.lit(2)) == 0, F.col(f"t_{x}")).otherwise(F.col(f"c_{x}"))
    out = similarity.unified_report(pairs.select(key.alias("pair_id"), mode.alias("mode"), side("a").alias("text_a"), F.when(F.pmod(key, F.lit(11)) == 5, " \n ").otherwise(side("b")).alias("text_b"), F.lit("JAVA").alias("lang")))
    return out.select("pair_id", "mode", "language", "scores.*", "final_similarity", "risk_level", "error")


def part_sql_functions(spark, sf):
    """The functions by SQL alone."""
    sql.register(spark)
    part_texts(spark, sf).createOrReplaceTempView("kinmark_part_texts")
    return spark.sql("""
        SELECT id_a, id_b, floor(jaccard_similarity(u, v) * 10000 + 0.5) / 10000 AS jaccard, floor(lcs_similarity(u, v) * 10000 + 0.5) / 10000 AS lcs,
               floor(tfidf_cosine(x, y) * 10000 + 0.5) / 10000 AS cosine, floor(edit_similarity(x, y) * 10000 + 0.5) / 10000 AS edits, detect_language(x) AS lang, risk_level(jaccard_similarity(u, v)) AS risk
        FROM (SELECT a.doc_id AS id_a, b.doc_id AS id_b, clean_text(a.text) AS x, clean_text(b.text) AS y, text_words(clean_text(a.text), '') AS u, text_words(clean_text(b.text), '') AS v
              FROM kinmark_part_texts a JOIN kinmark_part_texts b ON b.doc_id = a.doc_id + 1)""")


def near_duplicate_pairs(spark, sf):
    out = candidates.near_duplicate_links(candidates.shingle_sets(docs(spark, sf)))
    return out.withColumn("similarity", T.rounded(F.col("similarity")))


def near_duplicate_classes(spark, sf):
    return candidates.near_duplicates(candidates.shingle_sets(docs(spark, sf)))


def benchmark_contamination(spark, sf):
    items = candidates.shingle_prints(table(spark, sf, "benchmark"), "item_id")
    return candidates.shared_prints(candidates.shingle_prints(docs(spark, sf)), items)


def embedding_cosine_topk(spark, sf):
    return semantic.cosine_topk(table(spark, sf, "embeddings"))


def embedding_normalize(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", semantic.normalized(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), T.rounded(semantic.dot(F.col("v"), F.col("v"))).alias("norm"), T.rounded(F.col("v")[0]).alias("v0"))


def local_alignment_blocks(spark, sf):
    pairs, code = code_pairs(spark, sf)
    blocks = F.explode(kernels.alignment_blocks("code_a", "code_b", F.lit("python")))
    return similarity.with_sides(pairs, code, ["code"]).select("pair_id", "a", "b", blocks.alias("x")).select("pair_id", "a", "b", "x.*")


def history_page(spark, sf):
    rows = service.history(submissions(spark, sf), reports(spark, sf), mode="text", risk="bogus")
    return service.page(rows, 3).select("id", "user_id", "mode", "status", "created_at", "final_similarity", "risk_level")


def history_count(spark, sf):
    return service.history_count(submissions(spark, sf), reports(spark, sf), risk="HIGH")


def daily_quota(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("ts").alias("created_at"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "pro").otherwise("free").alias("plan"))
    return service.daily_quota(events, users).withColumn("day", F.col("day").cast("string"))


def rate_limit_window(spark, sf):
    return service.rate_windows(table(spark, sf, "events"))


def status_latest(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    events = table(spark, sf, "events").select(F.col("user_id").alias("submission_id"), status.alias("status"), F.nullif("event_type", F.lit("")).alias("error_message"), "ts")
    return service.latest_status(events)


def delete_cascade(spark, sf):
    gone = submissions(spark, sf).filter("status = 'completed' and mode = 'code'").select("id")
    subs, reps = service.without_submissions(submissions(spark, sf), reports(spark, sf), gone)
    return subs.select(F.lit("submission").alias("kind"), "id").unionByName(reps.select(F.lit("report").alias("kind"), F.col("submission_id").alias("id")))


def report_detail(spark, sf):
    out = service.report_detail(submissions(spark, sf), reports(spark, sf))
    return out.select("id", "status", F.col("scores.jaccard").alias("jaccard"), F.col("scores.ast").alias("ast"), "final_similarity", "risk_level")


def user_history(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return service.users_with_submissions(users, submissions(spark, sf))


def extension_filter(spark, sf):
    path = F.concat(F.col("p_name"), F.lit("."), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "PY").when(F.pmod("p_partkey", F.lit(3)) == 1, "docx").otherwise("exe"))
    files = table(spark, sf, "part").select("p_partkey", path.alias("path"))
    return files.select("p_partkey", service.extension(F.col("path")).alias("ext"), service.accepted(F.col("path"), F.lit("code")).alias("code"), service.accepted(F.col("path"), F.lit("text")).alias("text"))


def percent_labels(spark, sf):
    score = F.col("final_similarity")
    return reports(spark, sf).select("submission_id", (F.floor(score * 100 + 0.5)).cast("long").alias("bar"), service.bar_colour(score).alias("colour"), service.percent_label(score).alias("label"))


def submission_lookup(spark, sf):
    """Two submissions of one user, one of whom asks for another's: no row."""
    subs = submissions(spark, sf)
    return service.submission(subs, 3, 0).unionByName(subs.alias("s").join(service.submission(subs.withColumn("user_id", F.lit(7)), 5, 7).select("id"), "id")).select("id", "user_id", "mode", "status")


def page_spans(spark, sf):
    """Of each user's history, the page that is asked for, here the second, and which rows it shows."""
    users = user_history(spark, sf).select("id", F.col("n_submissions").alias("total"))
    return users.select("id", "total", service.page_span(F.col("total"), F.lit(2)).alias("p")).select("id", "total", "p.page", F.col("p.from").alias("first"), F.col("p.to").alias("last"))


def validators(spark, sf):
    c = table(spark, sf, "customer")
    password = F.concat(F.substring("c_name", 1, F.pmod(F.col("c_custkey"), F.lit(12)) + 1), F.lit("9"))
    return c.select("c_custkey", service.password_ok(password).alias("password"), service.name_ok(F.substring("c_name", 1, F.pmod(F.col("c_custkey"), F.lit(3)))).alias("name"))


def status_changes(spark, sf):
    """States that may follow: each order's next state, of which completed ones take none."""
    subs = submissions(spark, sf)
    current = subs.select(F.col("id").alias("submission_id"), "status")
    changes = subs.select(F.col("id").alias("submission_id"), F.when(F.pmod("id", F.lit(2)) == 0, "failed").otherwise("processing").alias("status"), F.repeat(F.lit("x"), F.pmod(F.col("id"), F.lit(2000)).cast("int")).alias("error_message"), F.col("created_at").alias("ts"))
    return service.status_events(changes, current).select("submission_id", "status", F.length("error_message").alias("n"))


def upload_checks(spark, sf):
    """Orders as uploads: two files each, by customers as users."""
    kinds, k = [".py", ".TXT", ".exe", ".docx"], F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(k, F.lit(4)) + 1).cast("int"))
    mode = F.when(F.pmod(k, F.lit(5)) == 4, "image").when(F.pmod(k, F.lit(4)) == 0, "code").otherwise("text")
    uploads = table(spark, sf, "orders").select(k.alias("id"), F.pmod("o_custkey", F.lit(50)).alias("user_id"), mode.alias("mode"), F.concat(F.lit("a"), ext).alias("name1"), (k * 997 % 12_000_000).alias("size1"), F.concat(F.lit("b.c"), ext).alias("name2"), F.lit(10).cast("long").alias("size2"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    before = submissions(spark, sf).select((F.pmod("user_id", F.lit(50))).alias("user_id"), F.col("created_at").cast("timestamp").alias("created_at")).filter("user_id < 10")
    users = table(spark, sf, "customer").filter("c_custkey < 50").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "pro").otherwise("free").alias("plan"))
    return service.checked_uploads(uploads, before, users).select("id", "user_id", "code", "error")


def queries() -> dict:
    plain = [
        text_clean, text_tokens, text_stopword_filter, text_jaccard, text_lcs, text_tfidf_cosine, text_report, risk_classify, lang_detect, code_clean_python, code_clean_c_like,
        kgram_hash, winnow_fingerprints, winnow_similarity, code_lcs, ast_edit_similarity, ast_ngram_jaccard, ast_node_edit_similarity, code_score_same_lang, code_score_cross_lang, unified_report,
        near_duplicate_pairs, near_duplicate_classes, benchmark_contamination, embedding_cosine_topk, embedding_normalize, local_alignment_blocks, history_page, history_count,
        daily_quota, rate_limit_window, status_latest, delete_cascade, report_detail, user_history, extension_filter, percent_labels, submission_lookup, page_spans, validators, status_changes, upload_checks,
        part_text_lcs, part_text_report, part_code_lcs, part_code_score_same_lang, part_code_score_cross_lang, part_ast_edit, part_unified_report, part_sql_functions,
    ]
    return {f.__name__: f for f in plain} | {f"code_tokens_{lang}": _tokens_query(lang) for lang in lexicon.LEXERS} | {"code_normalize" + f"_{lang}" * (lang != "python"): _normalize_query(lang) for lang in lexicon.LEXERS}


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sum(column: str, words) -> str:
    return " + ".join(f"CAST(contains({column}, '{w}') AS INT)" for w in words)


def _round(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


CLEAN = r"clean AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents)"
WORDS = CLEAN + ", words AS (SELECT doc_id, list_filter(string_split(clean, ' '), lambda t: t <> '') AS words FROM clean)"
KEPT = WORDS + f", kept AS (SELECT doc_id, list_filter(words, lambda t: t NOT IN ({_list(lexicon.STOP_WORDS)})) AS kept FROM words)"
PYTHON = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\"{3}.*?\"{3}', '', 'g'), '(?s)''{3}.*?''{3}', '', 'g'), '(?m)#.*?$', '', 'g'), '\s+', ' ', 'g'))"""
C_LIKE = r"""trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '(?m)//.*?$', '', 'g'), '\s+', ' ', 'g'))"""


def _named(lang: str = "python") -> str:
    cleaned = PYTHON if lang == "python" else C_LIKE
    return f"""lexed AS (SELECT doc_id, regexp_extract_all({cleaned}, '{lexicon.LEXERS[lang]}') AS w FROM documents), flat AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM lexed),
named AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS i FROM flat WHERE regexp_matches(t, '{lexicon.IDENTIFIER}') AND t NOT IN ({_list(lexicon.KEYWORDS[lang])}) GROUP BY doc_id, t),
norm AS (SELECT flat.doc_id, flat.pos, CASE WHEN i IS NULL THEN flat.t ELSE 'var' || i END AS t FROM flat LEFT JOIN named ON flat.doc_id = named.doc_id AND flat.t = named.t)"""


NAMED = _named()
HASHED = NAMED + ", grams AS (SELECT doc_id, pos, t || lead(t, 1) OVER w || lead(t, 2) OVER w AS g FROM norm WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), h AS (SELECT doc_id, pos, md5(g) AS h FROM grams WHERE g IS NOT NULL)"
_MIN = "least AS (SELECT doc_id, {pos} AS pos, min(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fp, count(*) OVER (PARTITION BY doc_id) AS n FROM h), fps AS (SELECT DISTINCT doc_id, fp FROM least WHERE pos >= 3 OR n < 4 AND pos = n - 1)"
WINNOWED = HASHED + ", " + _MIN.format(pos="pos")
SETS = "SELECT a.doc_id AS id_a, b.doc_id AS id_b, {a} AS a, {b} AS b FROM {t} a JOIN {t} b ON b.doc_id = a.doc_id + 1"
JACCARD = "CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END"
SUBMISSIONS = "s AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderpriority < '3' THEN 'code' ELSE 'text' END AS mode, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status, o_orderdate AS created_at FROM orders), r0 AS (SELECT o_orderkey AS submission_id, (o_orderkey * 37 % 1000) / 1000 AS final_similarity FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT *, CASE WHEN final_similarity < 0.3 THEN 'LOW' WHEN final_similarity < 0.5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM r0)"


def _shingled(source: str, key: str) -> str:
    cleaned = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g'))"
    grams = " || ' ' || ".join(["t", *[f"lead(t, {i}) OVER w" for i in range(1, 5)]])
    return f"""{source}_w AS (SELECT {key} AS doc_id, list_filter(string_split({cleaned}, ' '), lambda t: t <> '') AS w FROM {source}),
{source}_f AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM {source}_w),
{source}_g AS (SELECT doc_id, pos, md5({grams} || ' ') AS h FROM {source}_f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
{source}_l AS (SELECT doc_id, pos, min(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS fp, count(*) OVER (PARTITION BY doc_id) AS n FROM {source}_g WHERE h IS NOT NULL),
{source}_p AS (SELECT DISTINCT doc_id, fp FROM {source}_l WHERE pos >= 3 OR n < 4 AND pos = n - 1)"""


SHORT = r"CASE WHEN len(w) = 0 OR regexp_matches(regexp_replace(low, '[\x00-\x7F]', '', 'g'), '[\p{L}\p{M}\p{N}]') THEN low ELSE array_to_string(w, ' ') END"
NEAR = rf"""s0 AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS clean, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) AS low FROM documents),
s1 AS (SELECT doc_id, low, list_filter(string_split(clean, ' '), lambda t: t <> '') AS w FROM s0),
f AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM s1 WHERE len(w) >= 5),
g AS (SELECT doc_id, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w || ' ' || lead(t, 4) OVER w AS fp FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT DISTINCT doc_id, md5(fp) AS fp FROM g WHERE fp IS NOT NULL UNION ALL SELECT doc_id, md5({SHORT}) FROM s1 WHERE len(w) < 5),
keyed AS (SELECT doc_id, string_agg(fp, ',' ORDER BY fp) AS k FROM p GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM keyed),
reps AS (SELECT p.doc_id, fp, count(*) OVER (PARTITION BY p.doc_id) AS n FROM p JOIN cls USING (doc_id) WHERE p.doc_id = class_id),
links AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS s FROM reps a JOIN reps b ON a.fp = b.fp AND a.doc_id < b.doc_id GROUP BY ALL HAVING s >= 0.8)"""


def _terms() -> str:
    """x (id_a, id_b, dot, sa, sb, qa, qb): what the cosine of neighbours needs, after WORDS."""
    lemma = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in lexicon.LEMMAS.items())
    return f"""u AS (SELECT doc_id, list_filter(regexp_extract_all(array_to_string(list_transform(words, lambda w: CASE w {lemma} ELSE w END), ' '), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({_list(lexicon.tfidf_stop_words())})) AS u FROM words),
tflat AS (SELECT doc_id, unnest(u) AS t, unnest(range(len(u))) AS pos FROM u),
two AS (SELECT doc_id, t || ' ' || lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM tflat),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, t FROM tflat UNION ALL SELECT doc_id, t FROM two WHERE t IS NOT NULL) GROUP BY ALL),
sq AS (SELECT doc_id, sum(tf * tf) AS sq FROM tf GROUP BY doc_id),
tp AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
td AS (SELECT a.doc_id AS id_a, sum(a.tf * b.tf) AS dot, sum(a.tf * a.tf) AS sa, sum(b.tf * b.tf) AS sb FROM tf a JOIN tf b ON b.doc_id = a.doc_id + 1 AND a.t = b.t GROUP BY a.doc_id),
x AS (SELECT tp.id_a, tp.id_b, dot, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb, qa.sq AS qa, qb.sq AS qb FROM tp LEFT JOIN td USING (id_a) LEFT JOIN sq qa ON qa.doc_id = tp.id_a LEFT JOIN sq qb ON qb.doc_id = tp.id_b)"""


_K2 = repr(T.KAPPA * T.KAPPA)
COSINE = f"CASE WHEN qa IS NULL AND qb IS NULL THEN NULL WHEN dot IS NULL THEN 0.0 ELSE dot / (sqrt(CAST(sa AS DOUBLE) + CAST({_K2} AS DOUBLE) * CAST(qa - sa AS DOUBLE)) * sqrt(CAST(sb AS DOUBLE) + CAST({_K2} AS DOUBLE) * CAST(qb - sb AS DOUBLE))) END"
RISK = "CASE WHEN {0} < 0.3 THEN 'LOW' WHEN {0} < 0.5 THEN 'MEDIUM' WHEN {0} IS NOT NULL THEN 'HIGH' END"

PART_TEXTS = "documents AS (SELECT p_partkey AS doc_id, p_name || ' by ' || p_brand || ' is a ' || p_type || ' part of size ' || p_size || ' and it fits the ' || p_type || ' ' || p_name AS text FROM part)"


def _programs(lang: str = "'java'") -> str:
    return f"""documents AS (SELECT p_partkey AS doc_id, {lang} AS lang, 'class ' || replace(p_brand, '#', '_') || ' {{ int ' || replace(p_name, ' ', '_') || '(int size) {{ if (size > ' || p_size || ') {{ return size - ' || p_size || '; }} ' || CASE p_partkey % 3 WHEN 0 THEN 'for (int i = 0; i < size; i++) {{ total = total + i; }} return total;' WHEN 1 THEN 'while (size > 0) {{ size = size - 1; }} return size;' ELSE 'return new ' || p_type || '(size);' END || ' }} }} // ' || p_brand AS text FROM part)"""


def _lcs(name: str = "lcs") -> str:
    """name (id_a, id_b, a, b, n): the longest common subsequences of the pairs q (id_a, id_b, a, b), a row of the table a step."""
    return f"""dp AS (SELECT id_a, 0 AS j, list_transform(range(len(a) + 1), lambda i: CAST(0 AS BIGINT)) AS r FROM q
UNION ALL SELECT id_a, j + 1, list_concat([CAST(0 AS BIGINT)], list_transform(range(1, len(c) + 1), lambda i: list_max(c[1:i]))) FROM (
SELECT q.id_a, dp.j, list_transform(range(1, len(q.a) + 1), lambda i: greatest(dp.r[i + 1], dp.r[i] + CAST(q.a[i] = q.b[dp.j + 1] AS BIGINT))) AS c FROM dp JOIN q ON q.id_a = dp.id_a WHERE dp.j < len(q.b))),
{name} AS (SELECT q.id_a, q.id_b, q.a, q.b, dp.r[-1] AS n FROM q JOIN dp ON dp.id_a = q.id_a AND dp.j = len(q.b))"""


def _text_report() -> str:
    """report (id_a, id_b, jaccard, lcs, cosine, final_similarity), scores unrounded, of the table documents; WITH RECURSIVE."""
    return f"""{KEPT}, q AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.kept AS a, b.kept AS b FROM kept a JOIN kept b ON b.doc_id = a.doc_id + 1), {_lcs()}, {_terms()},
report0 AS (SELECT lcs.id_a, lcs.id_b, {JACCARD} AS jaccard, CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE n / least(len(a), len(b)) END AS lcs, {COSINE} AS cosine FROM lcs JOIN x ON x.id_a = lcs.id_a),
report AS (SELECT *, CAST(0.2 AS DOUBLE) * jaccard + CAST(0.2 AS DOUBLE) * lcs + CAST(0.6 AS DOUBLE) * cosine AS final FROM report0)"""


def _code_report() -> str:
    """report (id_a, id_b, lang_a, lang_b, w, l, a, final), scores unrounded, of documents with a lang of java or cpp."""
    marks = "|".join(m for m in kernels.MARKS if m.isalpha())
    return f"""lexed AS (SELECT doc_id, lang, CASE lang WHEN 'java' THEN regexp_extract_all({C_LIKE}, '{lexicon.LEXERS["java"]}') ELSE regexp_extract_all({C_LIKE}, '{lexicon.LEXERS["cpp"]}') END AS w FROM documents),
flat AS (SELECT doc_id, lang, unnest(w) AS t, unnest(range(len(w))) AS pos FROM lexed),
named AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS i FROM flat WHERE regexp_matches(t, '{lexicon.IDENTIFIER}') AND NOT (lang = 'java' AND t IN ({_list(lexicon.JAVA_KEYWORDS)})) AND NOT (lang = 'cpp' AND t IN ({_list(lexicon.CPP_KEYWORDS)})) GROUP BY doc_id, t),
norm AS (SELECT flat.doc_id, flat.pos, CASE WHEN i IS NULL THEN flat.t ELSE 'var' || i END AS t FROM flat LEFT JOIN named ON flat.doc_id = named.doc_id AND flat.t = named.t),
grams AS (SELECT doc_id, pos, t || lead(t, 1) OVER w || lead(t, 2) OVER w AS g FROM norm WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), h AS (SELECT doc_id, pos, md5(g) AS h FROM grams WHERE g IS NOT NULL),
{_MIN.format(pos="pos")}, ws AS (SELECT doc_id, list(t ORDER BY pos) AS w FROM norm GROUP BY doc_id), fs AS (SELECT doc_id, list(fp) AS f FROM fps GROUP BY doc_id),
nodes AS (SELECT doc_id, regexp_extract_all(text, '\\b(?:{marks})\\b|[{{}}();]') AS v FROM documents),
trees AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(v) - 1, 1)), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2])) AS v FROM nodes),
side AS (SELECT doc_id, lang, w, f, v FROM documents JOIN ws USING (doc_id) JOIN fs USING (doc_id) JOIN trees USING (doc_id)),
q AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, a.w AS a, b.w AS b FROM side a JOIN side b ON b.doc_id = a.doc_id + 1), {_lcs()},
wj AS (SELECT a.doc_id AS id_a, a.lang AS lang_a, b.lang AS lang_b, a.f AS a, b.f AS b FROM side a JOIN side b ON b.doc_id = a.doc_id + 1),
aj AS (SELECT a.doc_id AS id_a, a.v AS a, b.v AS b FROM side a JOIN side b ON b.doc_id = a.doc_id + 1),
parts AS (SELECT lcs.id_a, lcs.id_b, lang_a, lang_b, (SELECT {JACCARD} FROM (SELECT wj.a AS a, wj.b AS b)) AS w, n / greatest(len(lcs.a), len(lcs.b)) AS l, CASE WHEN lang_a = lang_b THEN (SELECT {JACCARD} FROM (SELECT aj.a AS a, aj.b AS b)) END AS a FROM lcs JOIN wj ON wj.id_a = lcs.id_a JOIN aj ON aj.id_a = lcs.id_a),
report AS (SELECT *, CASE WHEN a IS NULL THEN CAST(0.8 AS DOUBLE) * l + CAST(0.2 AS DOUBLE) * w ELSE CAST(0.4 AS DOUBLE) * w + CAST(0.3 AS DOUBLE) * l + CAST(0.3 AS DOUBLE) * a END AS final FROM parts)"""


_CODE_ROWS = f"SELECT id_a, id_b, lang_a, lang_b, {_round('w')} AS winnowing, {_round('l')} AS lcs, {_round('a')} AS ast, {_round('final')} AS final_similarity FROM report"


def _part_sql() -> dict[str, str]:
    rounded = f"SELECT id_a, id_b, {_round('jaccard')} AS jaccard, {_round('lcs')} AS lcs, {_round('cosine')} AS cosine, {_round('final')} AS final_similarity FROM report"
    marks = ", ".join(f"'{m}'" for m in kernels.MARKS)
    text, code = f"SELECT * FROM (WITH RECURSIVE {PART_TEXTS}, {_text_report()} {rounded})", f"SELECT * FROM (WITH RECURSIVE {_programs()}, {_code_report()} {_CODE_ROWS})"
    null = "CAST(NULL AS DOUBLE)"
    return {
        "part_text_lcs": f"WITH RECURSIVE {PART_TEXTS}, {_text_report()} SELECT id_a, id_b, {_round('lcs')} AS lcs FROM report",
        "part_text_report": f"WITH RECURSIVE {PART_TEXTS}, {_text_report()}, r AS ({rounded}) SELECT *, {RISK.format('final_similarity')} AS risk_level, CASE WHEN cosine IS NULL THEN 'empty vocabulary' END AS error FROM r",
        "part_code_lcs": f"WITH RECURSIVE {_programs()}, {_code_report()} SELECT id_a, id_b, {_round('l')} AS lcs FROM report",
        "part_code_score_same_lang": f"WITH RECURSIVE {_programs()}, {_code_report()} {_CODE_ROWS}",
        "part_code_score_cross_lang": f"WITH RECURSIVE {_programs("CASE p_partkey % 2 WHEN 0 THEN 'java' ELSE 'cpp' END")}, {_code_report()} {_CODE_ROWS}",
        "part_ast_edit": f"""WITH {_programs()}, nodes AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\\b(?:{"|".join(m for m in kernels.MARKS if m.isalpha())})\\b|[{{}}();]'), lambda t: chr(CAST(64 + list_position([{marks}], t) AS INT))), '') AS c FROM documents)
SELECT a.doc_id AS id_a, b.doc_id AS id_b, {_round("CASE WHEN a.c = '' AND b.c = '' THEN 1.0 WHEN a.c = '' OR b.c = '' THEN 0.0 ELSE greatest(0.0, 1 - levenshtein(a.c, b.c) / greatest(length(a.c), length(b.c))) END")} AS likeness FROM nodes a JOIN nodes b ON b.doc_id = a.doc_id + 1""",
        "part_unified_report": f"""WITH p AS (SELECT a.p_partkey AS k FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), m AS (SELECT k, CASE WHEN k % 7 = 3 THEN 'image' WHEN k % 2 = 0 THEN 'text' ELSE 'code' END AS mode, k % 11 = 5 AS blank FROM p),
t AS ({text}), c AS ({code}),
r AS (SELECT k AS pair_id, mode, 'english' AS language, jaccard, cosine, lcs, {null} AS winnowing, {null} AS ast, final_similarity, CASE WHEN cosine IS NULL THEN 'empty vocabulary' END AS error FROM m JOIN t ON id_a = k WHERE mode = 'text' AND NOT blank
UNION ALL SELECT k, mode, lang_a, {null}, {null}, lcs, winnowing, ast, final_similarity, NULL FROM m JOIN c ON id_a = k WHERE mode = 'code' AND NOT blank
UNION ALL SELECT k, mode, NULL, {null}, {null}, {null}, {null}, {null}, {null}, CASE mode WHEN 'image' THEN 'unknown mode' ELSE 'content is empty' END FROM m WHERE mode = 'image' OR blank)
SELECT *, {RISK.format('final_similarity')} AS risk_level FROM r""",
        "part_sql_functions": f"""WITH RECURSIVE {PART_TEXTS}, {_text_report()}, cl AS (SELECT a.doc_id AS id_a, a.clean AS x, b.clean AS y FROM clean a JOIN clean b ON b.doc_id = a.doc_id + 1)
SELECT report.id_a, id_b, {_round('jaccard')} AS jaccard, {_round('lcs')} AS lcs, {_round('cosine')} AS cosine, {_round("greatest(0.0, 1 - levenshtein(x, y) / greatest(length(x), length(y)))")} AS edits, 'python' AS lang, {RISK.format('jaccard')} AS risk FROM report JOIN cl ON cl.id_a = report.id_a""",
    }


def oracle_sql() -> dict[str, str]:
    p, c, j = (_sum(x, w) for x, w in (("lower(text)", lexicon.PYTHON_SIGNALS), ("lower(text)", lexicon.CPP_SIGNALS), ("text", lexicon.JAVA_SIGNALS)))
    sql = {
        "text_clean": f"WITH {CLEAN} SELECT * FROM clean",
        "text_tokens": f"WITH {WORDS} SELECT doc_id, CAST(unnest(range(len(words))) AS INT) AS pos, unnest(words) AS token FROM words",
        "text_stopword_filter": f"WITH {KEPT} SELECT doc_id, CAST(len(kept) AS INT) AS n, array_to_string(kept, ' ') AS kept FROM kept",
        "text_jaccard": f"WITH {KEPT}, x AS ({SETS.format(t='kept', a='list_distinct(a.kept)', b='list_distinct(b.kept)')}) SELECT id_a, id_b, {_round(JACCARD)} AS jaccard FROM x",
        "text_tfidf_cosine": f"WITH {WORDS}, {_terms()} SELECT id_a, id_b, {_round(COSINE)} AS cosine FROM x",
        "risk_classify": f"WITH {SUBMISSIONS} SELECT * FROM r",
        "lang_detect": f"SELECT doc_id, CASE WHEN p >= c AND p >= j THEN 'python' WHEN c >= j THEN 'cpp' ELSE 'java' END AS lang FROM (SELECT doc_id, {p} AS p, {c} AS c, {j} AS j FROM documents)",
        "code_clean_python": f"SELECT doc_id, {PYTHON} AS clean FROM documents",
        "code_clean_c_like": f"SELECT doc_id, {C_LIKE} AS clean FROM documents",
        "kgram_hash": f"WITH {HASHED} SELECT doc_id, CAST(pos AS INT) AS pos, h AS hash FROM h",
        "winnow_fingerprints": f"WITH {WINNOWED} SELECT * FROM fps",
        "winnow_similarity": f"""WITH {WINNOWED}, t AS (SELECT doc_id, list(t) AS t FROM norm GROUP BY doc_id), f AS (SELECT doc_id, list(fp) AS f FROM fps GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(t, []) AS t, coalesce(f, []) AS f FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id)),
x AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, len(a.t) AS n, len(b.t) AS m, CASE WHEN least(len(a.t), len(b.t)) < 3 THEN list_distinct(a.t) ELSE a.f END AS a, CASE WHEN least(len(a.t), len(b.t)) < 3 THEN list_distinct(b.t) ELSE b.f END AS b FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
SELECT id_a, id_b, {_round(f"CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN n = 0 OR m = 0 THEN 0.0 ELSE {JACCARD} END")} AS winnowing FROM x""",
        "ast_edit_similarity": f"SELECT p_partkey AS key, {_round('greatest(0.0, 1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)))')} AS likeness FROM part",
        "near_duplicate_pairs": f"WITH {NEAR} SELECT id_a, id_b, {_round('s')} AS similarity FROM links",
        "near_duplicate_classes": f"WITH {NEAR}, e AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM links UNION ALL SELECT id_b FROM links) GROUP BY id) SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM cls LEFT JOIN e ON e.id = class_id",
        "benchmark_contamination": f"WITH {_shingled('documents', 'doc_id')}, {_shingled('benchmark', 'item_id')}, b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM benchmark_p) SELECT d.doc_id, b.doc_id AS item_id, count(*) AS shared, {_round('count(*) / any_value(b.n)')} AS containment FROM documents_p d JOIN b USING (fp) GROUP BY d.doc_id, b.doc_id",
        "embedding_cosine_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-10) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, u.vec_id, {_round('least(greatest(list_inner_product(q.v, u.v) / (q.n * u.n), 0), 1)', 6)} AS similarity FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank, similarity FROM s QUALIFY rank <= 5""",
        "embedding_normalize": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), u AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-10) AS n FROM v)
SELECT vec_id, CAST(len(v) AS INT) AS n, {_round('list_inner_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))')} AS norm, {_round('v[1] / n')} AS v0 FROM u""",
        "history_page": f"WITH {SUBMISSIONS} SELECT id, user_id, mode, status, created_at, final_similarity, risk_level FROM s LEFT JOIN r ON submission_id = id WHERE mode = 'text' ORDER BY created_at DESC, id LIMIT 8 OFFSET 16",
        "history_count": f"WITH {SUBMISSIONS} SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 8), 1) AS BIGINT) AS pages FROM s JOIN r ON submission_id = id WHERE risk_level = 'HIGH'",
        "daily_quota": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) >= 5 AND coalesce(any_value(c_mktsegment), '') <> 'BUILDING' AS blocked FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY user_id, CAST(ts AS DATE)",
        "rate_limit_window": "SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n, count(*) > 20 AS over FROM events GROUP BY ALL",
        "status_latest": """WITH e AS (SELECT user_id AS submission_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status, nullif(event_type, '') AS error_message, ts FROM events)
SELECT *, CASE status WHEN 'failed' THEN 'Analysis failed: ' || coalesce(error_message, 'Unknown error') WHEN 'completed' THEN 'Analysis complete. Your report is ready.' ELSE 'Analysis is in progress. This may take a moment.' END AS message FROM e QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY ts DESC, status DESC) = 1""",
        "delete_cascade": f"WITH {SUBMISSIONS}, g AS (SELECT id FROM s WHERE status = 'completed' AND mode = 'code') SELECT 'submission' AS kind, id FROM s ANTI JOIN g USING (id) UNION ALL SELECT 'report', submission_id FROM r ANTI JOIN g ON submission_id = g.id",
        "report_detail": f"WITH {SUBMISSIONS} SELECT id, status, final_similarity AS jaccard, CAST(NULL AS DOUBLE) AS ast, final_similarity, risk_level FROM s LEFT JOIN r ON submission_id = id",
        "user_history": "SELECT c_custkey AS id, count(o_orderkey) AS n_submissions, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
        "extension_filter": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.docx' ELSE '.exe' END AS ext, p_partkey % 3 = 0 AS code, p_partkey % 3 = 1 AS text FROM part",
        "percent_labels": f"WITH {SUBMISSIONS}, b AS (SELECT submission_id, CAST(floor(final_similarity * 100 + 0.5) AS BIGINT) AS bar, final_similarity * 100 AS label FROM r) SELECT submission_id, bar, CASE WHEN bar >= 50 THEN 'red' WHEN bar >= 30 THEN 'yellow' ELSE 'green' END AS colour, format('{{:.1f}}', label) AS label FROM b",
        "submission_lookup": f"WITH {SUBMISSIONS} SELECT id, user_id, mode, status FROM s WHERE id = 3 AND user_id = 0 OR id = 5",
        "page_spans": "WITH h AS (SELECT c_custkey AS id, count(o_orderkey) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), p AS (SELECT *, CAST(least(2, greatest(ceil(total / 8), 1)) AS BIGINT) AS page FROM h) SELECT *, CASE WHEN total = 0 THEN 0 ELSE (page - 1) * 8 + 1 END AS first, least(page * 8, total) AS last FROM p",
        "validators": "WITH c AS (SELECT c_custkey, c_name[1:c_custkey % 12 + 1] || '9' AS p, trim(c_name[1:c_custkey % 3]) AS n FROM customer) SELECT c_custkey, length(p) BETWEEN 8 AND 128 AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[0-9]') AS password, length(n) BETWEEN 2 AND 100 AS name FROM c",
        "status_changes": f"WITH {SUBMISSIONS} SELECT id AS submission_id, CASE id % 2 WHEN 0 THEN 'failed' ELSE 'processing' END AS status, CASE id % 2 WHEN 0 THEN CAST(least(id % 2000, 1024) AS INT) END AS n FROM s WHERE status = 'pending' AND id % 2 = 1 OR status = 'processing' AND id % 2 = 0",
        "upload_checks": f"""WITH {SUBMISSIONS}, u AS (SELECT o_orderkey AS id, o_custkey % 50 AS user_id, CASE WHEN o_orderkey % 5 = 4 THEN 'image' WHEN o_orderkey % 4 = 0 THEN 'code' ELSE 'text' END AS mode, o_orderkey % 4 AS kind, greatest(o_orderkey * 997 % 12000000, 10) AS size, o_orderdate AS created_at FROM orders),
before AS (SELECT user_id % 50 AS user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM s WHERE user_id % 50 < 10 GROUP BY ALL),
t AS (SELECT u.*, sum(CAST(mode <> 'image' AS INT)) OVER (PARTITION BY u.user_id, CAST(created_at AS DATE) ORDER BY created_at, id) + coalesce(n, 0) > 5 AND coalesce(c_mktsegment, '') <> 'BUILDING' AS over FROM u LEFT JOIN before b ON b.user_id = u.user_id AND b.day = CAST(created_at AS DATE) LEFT JOIN customer ON c_custkey = u.user_id AND c_custkey < 50),
e AS (SELECT id, user_id, CASE WHEN mode = 'image' THEN 1 WHEN over THEN 2 WHEN kind = 2 THEN 3 WHEN size > 10485760 THEN 4 END AS e FROM t)
SELECT id, user_id, CAST([422, 429, 422, 413][e] AS INT) AS code, ['unknown mode', 'daily limit reached', 'file type not allowed', 'file too large'][e] AS error FROM e""",
    }
    for lang, pattern in lexicon.LEXERS.items():
        sql["code_normalize" + f"_{lang}" * (lang != "python")] = f"WITH {_named(lang)}, t AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS words FROM norm GROUP BY doc_id) SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN t USING (doc_id)"
        sql[f"code_tokens_{lang}"] = f"WITH t AS (SELECT doc_id, regexp_extract_all({PYTHON if lang == 'python' else C_LIKE}, '{pattern}') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INT) AS n, array_to_string(w, ' ') AS words FROM t"
    return sql | _part_sql()
