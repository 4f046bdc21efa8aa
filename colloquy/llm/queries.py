"""The queries of this subpackage: each applies one operator to its whole table, as it would be used."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, linededup, linerules, packing, quality, rolling, sharding, simhash, simple8b, urls, winnowing
from .common import new_path, spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, words=1, radius=2)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex(F.col("words")[0])), 16, "0").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dropped(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), "text")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(_documents(spark, sf_dir), n_shards=8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs, weights)
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), hits AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM hits
"""


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(_documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    simple8b.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    found = simple8b.read_tokens(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_documents(spark, sf_dir).select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM docs
), said AS (
  SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id
), told AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marks LEFT JOIN said USING (doc_id) GROUP BY part, fails
), growing AS (
  SELECT '' AS o UNION ALL
  SELECT o || c FROM growing, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(o, c)
), steps AS (
  SELECT o AS filter_order, k AS step, substr(o, k, 1) AS c, substr(o, 1, k - 1) AS before FROM growing, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(o) = 5
), counted AS (
  SELECT part, filter_order, step, c,
         sum(CASE WHEN fails = '' OR NOT regexp_matches(fails, '[' || before || c || ']') THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN contains(fails, c) AND (before = '' OR NOT regexp_matches(fails, '[' || before || '_]')) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN contains(fails, c) AND before <> '' AND regexp_matches(fails, '[' || before || '_]') THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN contains(fails, c) AND (before = '' OR NOT regexp_matches(fails, '[' || before || '_]')) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN contains(fails, c) AND (before = '' OR NOT regexp_matches(fails, '[' || before || '_]')) THEN toxic ELSE 0 END) AS toxic_lost
  FROM told, steps GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
       good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::bigint AS shapley
FROM counted
"""


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.clicks_apart(spread(table(spark, sf_dir, "clicks")), minutes=360)


OP12_SQL = """
WITH once AS (
  SELECT click_id, arg_min(ts, (ts, kind, value)) AS ts, arg_min(kind, (ts, kind, value)) AS kind, arg_min(CAST(floor(100 * value + 0.5) AS BIGINT), (ts, kind, value)) AS c
  FROM (SELECT DISTINCT click_id, ts, kind, value FROM clicks WHERE ts IS NOT NULL) GROUP BY click_id
), held AS (
  SELECT click_id, kind, c, list_sort(coalesce(list(c) FILTER (WHERE c IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL 360 MINUTES PRECEDING AND CURRENT ROW), [])) AS l FROM once
), centred AS (
  SELECT *, len(l) AS n, l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] AS median2 FROM held
), spread AS (
  SELECT *, list_sort([abs(2 * x - median2) for x in l]) AS d FROM centred
)
SELECT click_id, kind, n::bigint AS n, CASE WHEN n >= 5 THEN median2 END AS median2, CASE WHEN n >= 5 THEN d[(n + 1) // 2] + d[n // 2 + 1] END AS mad4,
       CASE WHEN n >= 5 THEN 2 * abs(2 * c - median2) > 5 * (d[(n + 1) // 2] + d[n // 2 + 1]) END AS far
FROM spread
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linerules.judged(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filters": op6_url_filters,
    "op7_winnowing": op7_winnowing,
    "op8_token_files": op8_token_files,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_rolling_median": op12_rolling_median,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE: dict[str, str] = {"op6_url_filters": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_rolling_median": OP12_SQL}
