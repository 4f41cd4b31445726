"""Queries on words without regular expressions, fill-in-the-middle, two tokenizers side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import alignment, byte_bpe, fill_middle, pieces, tables
from heliograph.llm.registry import query


@query()
def op11_byte_bpe_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(tables.read(spark, sf_dir, "documents"), pieces.vocabulary("byte_bpe_50k.tiktoken"))


MIDDLE_SQL = """
WITH hashes AS (
  SELECT doc_id, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS parts, sha256('7:' || doc_id) AS h
  FROM documents
), coins AS (
  SELECT doc_id, body, parts, len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS n,
         ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4
  FROM hashes
), ranks AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM coins
), cuts AS (
  SELECT *, length(array_to_string(parts[1:low], chr(10))) + CASE WHEN low > 0 AND low < len(parts) THEN 1 ELSE 0 END AS a,
         length(array_to_string(parts[1:high], chr(10))) + CASE WHEN high > 0 AND high < len(parts) THEN 1 ELSE 0 END AS b
  FROM ranks
), pieces AS (
  SELECT doc_id, n, form, a, b, body, substr(body, 1, a) AS pre, substr(body, a + 1, b - a) AS mid, substr(body, b + 1) AS suf FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM pieces
"""


@query(MIDDLE_SQL)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = fill_middle.transform(tables.read(spark, sf_dir, "documents"))
    restored = fill_middle.restored(F.col("output"), F.col("form"))
    return changed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


@query()
def op13_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return alignment.align_and_count(docs, pieces.vocabulary(), pieces.vocabulary("piece_bpe_32k.model"))
