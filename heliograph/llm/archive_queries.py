"""Query on web archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import tables, warc
from heliograph.llm.registry import query

ARCHIVE_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, encode(coalesce(html, '')) AS bytes FROM pages
), named AS (
  SELECT page_id, octet_length(bytes)::BIGINT AS payload_bytes, sha1(body) AS digest,
         min(page_id) OVER (PARTITION BY body) AS holder
  FROM payloads
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(digest, ''), lambda c:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS b
  FROM named
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
           + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM bits
"""


@query(ARCHIVE_SQL)
def op6_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = tables.read(spark, sf_dir, "pages"), tables.scratch_dir(spark, "warc")
    warc.write(pages, folder)
    return warc.lookup(spark, folder, pages, with_payload=False).drop("url")
