"""Queries on exact duplicates and host rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import exact_dedup, host_rules, tables
from heliograph.llm.registry import query

EXACT_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS kept,
       sha256(body) AS text_sha256
FROM texts
"""

HOST_SQL = r"""
WITH lists AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, w.i AS i, count(*) OVER (PARTITION BY doc_id, w.g) AS times
  FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 1),
      lambda i: {'i': i, 'g': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]})) AS w
    FROM lists
  )
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM windows, unnest([0, 1, 2]) AS o(k)
  WHERE times > 1
  GROUP BY doc_id
), counts AS (
  SELECT l.doc_id, l.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM lists l LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         100 * n_symbols > 5 * word_chars AS symbols_failed, 100 * n_dup_lines > 50 * n_lines AS lines_failed,
         word_chars < 3 * n_words OR word_chars > 10 * n_words AS length_failed
  FROM counts c
), rules AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f
  FROM (UNPIVOT (SELECT source, base_failed, symbols_failed, lines_failed, length_failed FROM judged WHERE source IS NOT NULL)
        ON base_failed, symbols_failed, lines_failed, length_failed INTO NAME rule VALUE failed)
  GROUP BY source, rule
), means AS (
  SELECT rule, sum(f) / sum(n) AS m FROM rules GROUP BY rule
), prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) END AS k
  FROM (SELECT rule, m, sum(n * pow(f / n - m, 2)) / sum(n) AS v FROM rules JOIN means USING (rule) GROUP BY rule, m)
), rates AS (
  SELECT source, m, coalesce((f + m * k) / (n + k), m) AS rate FROM rules JOIN prior USING (rule)
), bad AS (
  SELECT DISTINCT source FROM rates WHERE rate * (1 - m) >= 4 * m * (1 - rate) AND rate >= 0.2
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM judged
"""


@query(EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(tables.read(spark, sf_dir, "documents"))


@query(HOST_SQL)
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.verdicts(tables.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
