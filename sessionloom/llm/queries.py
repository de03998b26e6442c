"""The registered queries of the training-data operators, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, jaccard_trie, langid, merge_dropout, packing, pii, quality, recompression, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup_substrings(table(spark, sf_dir, "documents"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_trie.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(table(spark, sf_dir, "documents"), seed=1, rate=0.1, digest=True)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query
def base_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5 SQL can say: host, path and the fitting rule with its verdict."""
    ruled = F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled")
    return op5_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", ruled)


@query
def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7 SQL can say: its counts and base_failed, and that no such document is kept."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & F.col("base_failed")).alias("wrongly_kept"))


@query
def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can say: counts and digest of the base spans."""
    return op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


ORACLES["base_url_rules"] = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM rest
), rules(ruled, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, arg_max(ruled, length(h || p)) AS ruled
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
"""

ORACLES["base_quality"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM w, range(1, len(ws) - 1) t(i)
), twice AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM win, range(0, 3) r(j) WHERE n > 1 GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
       len(ws) < 50 OR 100 * coalesce(n, 0) > 50 * len(ws) AS base_failed, false AS wrongly_kept
FROM w LEFT JOIN twice ON w.doc_id = twice.doc_id
"""

ORACLES["base_pii"] = r"""
WITH patterns(k, kind, p) AS (
  VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
         (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')
), hits AS (
  SELECT doc_id, k, kind, regexp_extract_all(coalesce(text, ''), p) AS ms, string_split_regex(coalesce(text, ''), p) AS ps FROM documents, patterns
), spans AS (
  SELECT doc_id, k, kind, ms[i] AS m, (list_sum(list_transform(ps[1 : i], lambda x : length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x : length(x))), 0))::BIGINT AS s
  FROM hits, range(1, len(ms) + 1) t(i)
), checked AS (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM spans
), good AS (
  SELECT doc_id, k, s, kind || ':' || s || ':' || (s + length(m)) AS span FROM checked WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x : length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i : CASE WHEN i % 2 = 0 THEN substr(d, (length(d) - i)::INTEGER, 1)::INTEGER
      WHEN substr(d, (length(d) - i)::INTEGER, 1)::INTEGER > 4 THEN 2 * substr(d, (length(d) - i)::INTEGER, 1)::INTEGER - 9 ELSE 2 * substr(d, (length(d) - i)::INTEGER, 1)::INTEGER END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END
)
SELECT d.doc_id, count(k) FILTER (k = 0) AS n_email, count(k) FILTER (k = 1) AS n_ip, count(k) FILTER (k = 2) AS n_card, count(k) FILTER (k = 3) AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, k), '')) AS base_sha256
FROM documents d LEFT JOIN good ON d.doc_id = good.doc_id GROUP BY d.doc_id
"""

ORACLES["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS k FROM w, range(1, len(ws) - 18) t(i)
), judged AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win
), gone AS (
  SELECT DISTINCT doc_id, i + j AS at FROM judged, range(0, 20) r(j) WHERE rn > 1
), words AS (
  SELECT doc_id, i AS at, ws[i] AS word FROM w, range(1, len(ws) + 1) t(i)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.at) AS kept, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.at = gone.at GROUP BY words.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

ORACLES["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM w, range(1, greatest(len(ws) - 2, 2)) t(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN sizes ON w.doc_id = sizes.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""

ORACLES["op4_warc"] = """
WITH b AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM b WHERE n >= 100 GROUP BY d
)
SELECT page_id, n::BIGINT AS payload_bytes, b.d AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b LEFT JOIN f ON b.d = f.d AND n >= 100
"""

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
