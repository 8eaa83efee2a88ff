"""Reading and writing."""

from pyspark.sql import types as T

from estate_spark import session
from estate_spark.plans import QUERIES
from estate_spark.session import scratch_path
from estate_spark.sources import io

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_csv_empty_is_null_and_bad_line_is_kept(spark):
    path = scratch_path(spark, "csv-test")
    spark.createDataFrame([("a,b",), ("1,x",), ("2,",), ("oops,y",)], "value string").coalesce(1).write.text(path)
    rows = io.read_raw_csv(spark, path, SCHEMA).cache()
    got = sorted(rows.collect(), key=lambda r: (r["a"] is None, r["a"]))
    assert [(r["a"], r["b"]) for r in got[:2]] == [(1, "x"), (2, None)]
    assert got[2]["a"] is None and got[2][io.CORRUPT] == "oops,y"


def test_export_keeps_rows_and_writes_the_caveat(spark):
    path = scratch_path(spark, "export-test")
    io.export_csv(spark.createDataFrame([(1, "x"), (2, None)], SCHEMA), path, "careful")
    back = io.read_raw_csv(spark, path, SCHEMA).select("a", "b").collect()
    assert sorted(map(tuple, back)) == [(1, "x"), (2, None)]
    assert [r[0] for r in spark.read.text(f"{path}.caveat").collect()] == ["# careful"]


def test_pruned_scan_reads_two_columns(spark, sf):
    plan = io.read_table(spark, sf, "lineitem", ["l_orderkey", "l_quantity"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_wkt_edges(spark):
    df = spark.createDataFrame([("MULTIPOLYGON(((0 0, 2 0, 2 1, 0 0)))",)], "wkt string")
    r = io.load_zones(df).first()
    assert [tuple(e) for e in r["edges"]] == [(0, 0, 2, 0), (2, 0, 2, 1), (2, 1, 0, 0)]
    assert (r["x_min"], r["x_max"], r["y_min"], r["y_max"]) == (0, 2, 0, 1)


def test_zones_parse_each_text_once_and_spread_over_tasks(spark, sf, monkeypatch):
    """Nothing that is used twice is evaluated twice, and rows that cost much don't stay in one task."""
    plan = QUERIES["scan_wkt"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert "Filter" not in plan[plan.index("Repartition"):]
    from estate_spark.sources import driver_tables
    monkeypatch.setattr(driver_tables, "spread", lambda t: session.spread(t, 20))
    rows = driver_tables.raw_parcels(spark, sf)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 20)
    empty = session.spread(spark.createDataFrame([], "a int"))
    assert empty.rdd.getNumPartitions() == 1 and empty.count() == 0
