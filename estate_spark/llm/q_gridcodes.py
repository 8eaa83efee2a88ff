"""op13: product codes of all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.llm import gridcodes
from estate_spark.llm.registry import query, table

_NEAREST = """SELECT vec_id, row_no, p, u, min(struct_pack(d := d, i := i)) AS best FROM (
    SELECT a.vec_id, a.row_no, a.p, a.u, b.i, list_inner_product(a.u, a.u) - 2 * list_inner_product(a.u, b.c) + list_inner_product(b.c, b.c) AS d
    FROM parts a JOIN book{k} b ON b.p = a.p) q GROUP BY ALL"""
_MOVED = """SELECT p, i, list(coalesce(m, c) ORDER BY j) AS c FROM (
    SELECT b.p, b.i, j, b.c[j + 1] AS c, m FROM (SELECT *, unnest(range(len(c))) AS j FROM book{k}) b
    LEFT JOIN (SELECT p, best.i AS i, j, floor(sum(u[j + 1]) / count(*)) AS m
               FROM (SELECT *, unnest(range(len(u))) AS j FROM near{k}) n GROUP BY ALL) s USING (p, i, j)) q GROUP BY ALL"""
_STEPS = ",\n".join(
    f"near{k} AS MATERIALIZED ({_NEAREST.format(k=k)})" + (f",\nbook{k + 1} AS MATERIALIZED ({_MOVED.format(k=k)})" if k < gridcodes.ROUNDS else "")
    for k in range(gridcodes.ROUNDS + 1))

CODE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row_no, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, row_no, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS u FROM kept, (SELECT unnest(range(4)) AS p) q),
book0 AS MATERIALIZED (SELECT p, row_no - 1 AS i, u AS c FROM parts WHERE row_no <= 256),
{_STEPS},
coded AS (
  SELECT row_no, string_agg(printf('%02x', best.i), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{gridcodes.ROUNDS} GROUP BY row_no)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, i, j)) FROM (
    SELECT p, i, unnest(c) AS x, unnest(range(len(c))) AS j FROM book{gridcodes.ROUNDS}) q) AS codebooks_sha256
FROM coded JOIN kept USING (row_no)
"""


@query("op13_vector_codes", CODE_SQL)
def op13_vector_codes(spark, sf_dir):
    """Codebooks of four parts and 256 entries fitted on all vectors; every vector coded."""
    vectors = table(spark, sf_dir, "embeddings")
    books = gridcodes.train(vectors)
    out = gridcodes.with_label_error(gridcodes.encode(vectors, books))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                      F.lit(gridcodes.books_sha256(books)).alias("codebooks_sha256"))
