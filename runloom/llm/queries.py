"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runloom.llm import ann, attribution, bpe, language, manifest, outliers, packing, quality, simhash, spelling, substrings, toxicity, urls
from runloom.llm.common import fold
from runloom.llm.registry import ORACLES, QUERIES, query, table, vocabulary

__all__ = ["QUERIES", "ORACLES"]


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, model = language.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = language.identify(docs, names, model, keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "n_languages")


@query("op3_nearest")
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@query("op4_outliers")
def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 4)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.detect(docs, labels, for_model=part.isin(0, 1), for_calibration=part == 3, keep=["doc_id"])
    return found.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# The rules that the contract names.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URL_SQL = """
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
    SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
fits AS (
    SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
    FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
"""


@query("op8_url_filter", URL_SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 5)
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable=part != 0)
    return found.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ["text"])


MANIFEST_SQL = """
WITH RECURSIVE bytes AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
),
numbered AS (
    SELECT *, row_number() OVER () AS row FROM documents
),
fields AS (
    SELECT row, doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS own,
        coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1)::VARCHAR, '-') AS more, coalesce(strlen(text) || ':' || text, '-') AS tail,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
    FROM numbered, bytes
),
leaves AS (
    SELECT row, doc_id, lang, sha256(head || own || tail) AS leaf, sha256(head || CASE WHEN crc % 7 = 0 THEN more ELSE own END || tail) AS changed FROM fields
),
nodes AS (
    SELECT lang, 0 AS height, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS rank, leaf AS h, count(*) OVER (PARTITION BY lang) AS total FROM leaves
    UNION ALL
    SELECT lang, any_value(height) + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), any_value((total + 1) // 2) FROM nodes WHERE total > 1 GROUP BY lang, rank // 2
),
subroots AS (
    SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS total FROM nodes WHERE total = 1
),
tops AS (
    SELECT 0 AS height, rank, h, total FROM subroots
    UNION ALL
    SELECT any_value(height) + 1, rank // 2, sha256(string_agg(h, '' ORDER BY rank)), any_value((total + 1) // 2) FROM tops WHERE total > 1 GROUP BY rank // 2
),
walks AS (
    SELECT row, lang, 0 AS height, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS total, changed AS h, '' AS proof FROM leaves
    UNION ALL
    SELECT w.row, w.lang, w.height + 1, w.rank // 2, (w.total + 1) // 2,
        sha256(CASE WHEN w.rank % 2 = 1 THEN n.h || w.h ELSE w.h || coalesce(n.h, '') END), w.proof || coalesce(n.h, '')
    FROM walks w LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM w.lang AND n.height = w.height AND n.rank = xor(w.rank, 1) WHERE w.total > 1
),
ends AS (
    SELECT w.row, 0 AS height, s.rank, s.total, w.h, w.proof, s.h AS subroot FROM walks w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.total = 1
    UNION ALL
    SELECT w.row, w.height + 1, w.rank // 2, (w.total + 1) // 2,
        sha256(CASE WHEN w.rank % 2 = 1 THEN n.h || w.h ELSE w.h || coalesce(n.h, '') END), w.proof || coalesce(n.h, ''), w.subroot
    FROM ends w LEFT JOIN tops n ON n.height = w.height AND n.rank = xor(w.rank, 1) WHERE w.total > 1
),
roots AS (SELECT h AS root FROM tops WHERE total = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM ends JOIN leaves USING (row) CROSS JOIN roots WHERE total = 1
"""


@query("op11_manifest", MANIFEST_SQL)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tamper = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    found = manifest.document_manifest(table(spark, sf_dir, "documents"), tamper)
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


@query("op12_substrings")
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"), with_text=False)


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), least=7, occurrences=2, slip=31, ratio=10)
