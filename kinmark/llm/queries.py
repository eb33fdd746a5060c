"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, bpe, common, ctph, decontam, html_extract, line_dedup, sharding, simhash, substring_dedup, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edit_report(table(spark, sf_dir, "documents"))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_dir(spark)
    bitplane.write_ids(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return bitplane.read_summary(spark, path)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN, decoded=True)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def held_out(doc_id):
    """The fifth of ids that training never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir))
    out = scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def queries() -> dict:
    found = [op1_substring_dedup, op2_simhash, op3_sharding, op4_decontamination, op5_fingerprints, op6_token_planes, op7_bpe, op8_line_dedup, op9_html, op10_toxicity]
    return {f.__name__: f for f in found}


_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM p),
least AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
hit AS (SELECT DISTINCT h.doc_id, h.i + x.j AS pos FROM h JOIN least ON h.h = least.h AND least.lo < h.doc_id CROSS JOIN (SELECT unnest(range(50)) AS j) x),
gone AS (SELECT doc_id, list(pos) AS pos FROM hit GROUP BY doc_id),
k AS (SELECT w.doc_id, words, coalesce(gone.pos, []) AS pos FROM w LEFT JOIN gone USING (doc_id)),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS t FROM u ANTI JOIN hit ON u.doc_id = hit.doc_id AND u.i = hit.pos GROUP BY u.doc_id)
SELECT k.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(pos) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM k LEFT JOIN kept USING (doc_id)
"""

_OP4 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS g
       FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN names USING (doc_id)
"""

_OP8 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, often.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def _sharding_sql() -> str:
    """The look-up is SQL; the table, which shards fill turn by turn, stands in it as a list (tested by itself)."""
    table = ",".join(map(str, sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)]).tolist()))
    return f"""
WITH t AS (SELECT [{table}] AS shards),
s AS (SELECT doc_id, CAST(CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT) % {sharding.SIZE} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM s, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op3_sharding": _sharding_sql(), "op4_decontamination": _OP4, "op8_line_dedup": _OP8}
