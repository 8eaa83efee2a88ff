"""op8: all documents dealt to 24 shards by their key."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.llm import sharding
from estate_spark.llm.registry import query, table

SHARDS = 24

SHARD_SQL = f"""
WITH RECURSIVE crc_bits AS (
  SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_bits WHERE k = 8),
keys AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT AS key FROM documents),
jumps AS (
  SELECT row_no, key::HUGEINT AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM keys
  UNION ALL
  SELECT row_no, next, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next >> 33) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT row_no, b, j, (state * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next
        FROM jumps WHERE j < {SHARDS})),
placed AS (
  SELECT row_no, max(b) FILTER (WHERE b < {SHARDS}) AS shard, bool_or(j = {SHARDS}) AS moves FROM jumps GROUP BY row_no)
SELECT doc_id, CAST(strlen(text) + {sharding.ROW_OVERHEAD} AS BIGINT) AS size, 
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(text)),
    lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32, 'key' AS law,
  CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot,
  CAST(CASE WHEN moves THEN {SHARDS} ELSE shard END AS INTEGER) AS grown_shard
FROM keys JOIN placed USING (row_no), crc_table
"""


@query("op8_sharding", SHARD_SQL)
def op8_sharding(spark, sf_dir):
    """Jump consistent hash of doc_id; law ``key``."""
    docs = table(spark, sf_dir, "documents")
    out = sharding.assign(docs, SHARDS)
    return out.withColumn("law", F.lit("key"))
