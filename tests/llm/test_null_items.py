"""Benchmark items without an id count under the empty id, in the operator and in its SQL."""

import duckdb

from estate_spark.llm import decontaminate
from estate_spark.llm.q_decontaminate import DECONTAMINATE_SQL
from estate_spark.llm.queries import QUERIES

DOCS = [(1, "x alpha beta gamma y"), (2, "delta epsilon"), (3, "alpha beta gamma delta epsilon"), (4, None)]
ITEMS = [(None, "alpha beta gamma"), ("b", "delta epsilon"), (None, "no such words"), ("c", None)]


def test_null_item_id(spark, tmp_path):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in decontaminate.matches(docs, items).collect()}
    assert got == {1: (3, [""]), 2: (2, ["b"]), 3: (5, ["", "b"]), 4: (0, [])}
    assert [r["doc_id"] for r in decontaminate.drop(docs, items).collect()] == [4]
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(DECONTAMINATE_SQL)
    rows = QUERIES["op4_decontamination"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
