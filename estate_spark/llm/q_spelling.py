"""op12: spelling variants among the words of all documents."""

from __future__ import annotations

from estate_spark.llm import spelling
from estate_spark.llm.registry import query, table

SLIP = 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPELLING_SQL = f"""
WITH RECURSIVE crc_bits AS (
  SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{_UPPER}', '{_LOWER}') AS w
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen(id || ':' || w)),
    lambda i: CAST(('0x' || substr(hex(encode(id || ':' || w)), 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) AS h FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, e, left(word, e) AS a, substr(word, e + 2) AS b FROM (SELECT word, unnest(range(length(word))) AS e FROM words) q),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.e = y.e WHERE x.word <> y.word
  UNION SELECT x.word, w.word FROM cut x JOIN words w ON w.word = x.a || x.b
  UNION SELECT w.word, x.word FROM cut x JOIN words w ON w.word = x.a || x.b),
best AS (
  SELECT near.word, count(*) AS n_near, min(struct_pack(less := -o.n, near := o.word)) AS best
  FROM near JOIN words o ON o.word = near.other GROUP BY 1),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.near END AS form,
    CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS root, n FROM words
  UNION ALL
  SELECT s.word, f.form, f.form_n FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN (SELECT word, arg_max(root, n) AS root FROM steps GROUP BY 1) r USING (word)
"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12_spelling_variants(spark, sf_dir):
    """Words of all documents with planted slips, their near words, forms and roots."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), slip=SLIP)
    return spelling.forms(words).select("word", "form", "root", "n", "n_near", "form_n")
