"""Splits and samples by cut-offs: the same rows as by ranks, and no exchange of the data."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from estate_spark.operators import ranks, sampling


def order(key, seed=42):
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16), key


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000])
def test_split_by_ranks(spark, n):
    keys = sorted((f"k{i}" for i in range(n)), key=order)
    test = math.ceil(0.2 * n)
    val = math.ceil(0.2 * (n - test))
    want = {k: "test" if i < test else "val" if i < test + val else "train" for i, k in enumerate(keys)}
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "asset_id string")
    assert {r["asset_id"]: r["split"] for r in sampling.split_3way(df).collect()} == want


@pytest.mark.parametrize("n", [1, 5, 50, 499, 5000])
def test_sample_by_ranks(spark, n):
    rows = [(f"k{i}", None if i % 11 == 0 else i % 3 if i % 2 else 0) for i in range(500)]
    by = {}
    for k, label in rows:
        by.setdefault(label, []).append(k)
    picked = [k for ks in by.values() for k in sorted(ks, key=order)[:math.ceil(len(ks) / 500 * n)]]
    df = spark.createDataFrame(rows, "id string, label int").withColumn("cut0", F.lit("mine"))
    got = sampling.stratified_sample(df, "id", "label", n)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(sorted(picked, key=order)[:n])


def test_cutoffs_of_shared_buckets(spark):
    """Both cut-offs in one bucket, and ranks beyond the class."""
    df = spark.createDataFrame([(f"k{i}", i % 2) for i in range(400)], "id string, c int")
    rows = ranks.hash_cutoffs(df, "id", 7, ["c"], lambda n: [F.lit(3), F.lit(4), n], buckets_log2=2).collect()
    for r in rows:
        ordered = sorted((f"k{i}" for i in range(400) if i % 2 == r["c"]), key=lambda k: order(k, 7))
        assert (r["cut0"]["_k"], r["cut1"]["_k"], r["cut2"], r["class_rows"]) == (ordered[3], ordered[4], None, 200)


def test_rows_do_not_move(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("asset_id"), (F.col("id") % 7).alias("label"))
    out = sampling.split_3way(df)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Range" in plan and not any(x in plan for x in ("Window", "Sort", "Join", "Exchange", "Aggregate"))
    assert out.rdd.getNumPartitions() == df.rdd.getNumPartitions()
