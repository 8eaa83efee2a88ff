"""The level dictionary: dense numbers in order at any size, joins that keep every row, sparse vectors."""

import pytest
from pyspark.sql import functions as F

from estate_spark.operators import features, ranks


def test_numbers_are_dense_and_ordered(spark):
    rows = [("b", 2), ("a", None), (None, 10), ("b", 9), ("é", 2), ("", 1)] * 3
    levels = features.fit_levels(spark.createDataFrame(rows, "s string, n int").repartition(4), ["s", "n"])
    got = {(r["column_name"], r["level"]): r["idx"] for r in levels.collect()}
    assert got == {("s", ""): 0, ("s", "a"): 1, ("s", "b"): 2, ("s", "é"): 3, ("n", "1"): 0, ("n", "10"): 1, ("n", "2"): 2, ("n", "9"): 3}
    assert features.level_counts(levels, ["s", "n", "none"]) == {"s": 4, "n": 4, "none": 0}


def test_a_million_levels(spark, monkeypatch):
    """No list of levels anywhere; a third of the rows has one level; unseen and null stay apart."""
    n = 1_000_000
    df = spark.range(n).select(F.format_string("L%07d", F.col("id")).alias("c"))
    levels = features.fit_levels(df, ["c"])
    one = levels.agg(F.count("*"), F.min("idx"), F.max("idx"), F.count_if(F.col("level") != F.format_string("L%07d", F.col("idx")))).first()
    assert tuple(one) == (n, 0, n - 1, 0)
    assert not ranks.is_small(levels, ranks.FEW_ROWS)
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "L0000007").when(F.col("id") % 3 == 1, F.format_string("L%07d", F.col("id") * 33)).when(
        F.col("id") % 2 == 0, "strange").alias("c"))
    got = features.one_hot(rows, levels, ["c"])
    assert got.count() == 30_000
    for r in got.filter("id < 12").collect():
        v, want = r["c_onehot"], n if r["c"] in (None, "strange") else int(r["c"][1:])
        assert (v.size, v.indices.tolist(), v.values.tolist()) == (n + 1, [want], [1.0])


@pytest.mark.parametrize("few", [0, 100_000])
def test_both_joins_agree(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW_ROWS", few)
    df = spark.createDataFrame([(i, "x" if i % 3 else f"v{i % 5}", None if i % 4 == 0 else i % 7) for i in range(200)], "id long, a string, b int")
    levels = features.fit_levels(df.filter("id < 90"), ["a", "b"])
    out = {r["id"]: (r["a_index"], r["b_index"]) for r in features.encode(df, levels, ["a", "b"]).collect()}
    known = [sorted({str(v) for i, v in ((r["id"], r[c]) for r in df.collect()) if i < 90 and v is not None}) for c in ("a", "b")]
    assert out == {r["id"]: tuple(k.index(str(v)) if v is not None and str(v) in k else None for k, v in zip(known, (r["a"], r["b"]))) for r in df.collect()}


def test_no_levels(spark):
    df = spark.createDataFrame([(1, None)], "id long, c string")
    levels = features.fit_levels(df, ["c"])
    assert levels.count() == 0 and features.one_hot(df, levels, ["c"]).first()["c_onehot"].toArray().tolist() == [1.0]
