"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, html_extract, quality_classifier, quality_rules, shared, simhash, substring_dedup, token_count, token_store, url_filter


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(shared.table(spark, sf_dir, "pages"))


#: Rules of the url filter: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(shared.table(spark, sf_dir, "pages"), URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    counts = token_count.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_count.over_limit(counts).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(shared.table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(shared.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    weights = quality_classifier.train(docs, shared.table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs, weights, ["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    with shared.Scratch(spark) as scratch:
        path = f"{scratch.root}/store"
        token_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
        stored = spark.read.parquet(path)
        return scratch.keep(token_store.starts(token_store.checksums(stored), stored).select("doc_id", "start", "n_tokens", "ids_crc32"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.substring_dedup(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    coded = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_url_filter": op2_url_filter,
        "op3_decontamination": op3_decontamination,
        "op4_token_count": op4_token_count,
        "op5_simhash": op5_simhash,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_token_store": op8_token_store,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_byte_bpe": op10_byte_bpe,
    }


OP2_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS rank
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE rank = 1) f USING (page_id, host, path)
"""

OP3_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words WHERE len(w) > 0
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 4 + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM doc_words WHERE len(w) >= 5
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w FROM documents
), hashed AS (
  SELECT doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS h FROM d WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM hashed
), firsts AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (h) WHERE doc_id > first
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op3_decontamination": OP3_SQL, "op9_substring_dedup": OP9_SQL}
