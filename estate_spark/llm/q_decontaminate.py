"""op4: every document against every benchmark item."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.llm import decontaminate
from estate_spark.llm.registry import query, table

# words of both sides; every item window of n words against every stretch of n document words
DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
stretches AS (
  SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
found AS (SELECT s.row_no, s.i, s.n, wins.item_id FROM stretches s JOIN wins ON s.n = wins.n AND s.p = wins.p),
hits AS (SELECT row_no, count(DISTINCT k) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS k FROM found) GROUP BY row_no),
own AS (
  SELECT row_no, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT row_no, item_id FROM found) GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row_no) LEFT JOIN own USING (row_no)
"""


@query("op4_decontamination", DECONTAMINATE_SQL)
def op4_decontamination(spark, sf_dir):
    """Windows of ten words of all items, whole texts."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
