"""Results that must not depend on size switches, column pruning or the sink."""

import math

import pytest
from pyspark.sql import functions as F

from estate_spark.operators import comps, curate, evaluate, explore, lookup, models, quality, ranks
from estate_spark.plans import modelling
from test_spatial import SCHEMA, as_pool, brute, pool_rows


def test_medians_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), ("c", math.nan)], "g string, v double")
    a, b = ({r["g"]: r["v"] for r in ranks.medians(df, ["v"], ["g"], small=s).collect()} for s in (True, False))
    assert a == b == {"a": 2.0, "b": None, None: 5.0, "c": None}
    assert ranks.medians(df.limit(0), ["v"], ["g"], small=False).count() == 0
    listings = df.select(F.col("g").alias("neighborhood_name"), F.col("v").alias("price"), F.col("v").alias("unit_price_m2")).filter("not isnan(v) or v is null")
    got = [{tuple(r) for r in explore.group_medians(listings, small=s).collect()} for s in (True, False)]
    assert got[0] == got[1] and ("b", None, None, 1) in got[0]


def test_rows_without_a_place_answer_nothing_on_both_paths(spark):
    rows = [*pool_rows(150, 4, 0.2), ("NULL1", "flat", None, -3.7, 50.0, 2), ("NULL2", "flat", 40.4, -3.7, None, 2)]
    subs = [(r[0], r[0], *r[1:]) for r in rows[:20] + rows[-2:]]
    s, pool = spark.createDataFrame(subs, "subject_id string, " + SCHEMA), as_pool(spark, rows)
    few, bulk = ({(r["subject_id"], r["rank"], r["asset_id"]) for r in comps.comparables(s, pool, 5, few=n).collect()} for n in (64, 0))
    assert few == bulk and not any("NULL" in x for r in few for x in (r[0], r[2]))


def test_sparse_type_beside_a_large_one(spark):
    large = [(f"L{i}", "flat", 40.0 + (i * 37 % 1000) / 2000, -4.0 + (i * 91 % 1000) / 2000, 30.0 + i % 90, i % 5) for i in range(3000)]
    sparse = [(f"S{i}", "loft", 40.0 + (i * 53 % 500) / 1000, -4.0 + (i * 71 % 500) / 1000, 30.0 + i % 70, i % 4) for i in range(200)]
    subs = [(r[0], r[0], *r[1:]) for r in sparse]
    s, pool = spark.createDataFrame(subs, "subject_id string, " + SCHEMA), as_pool(spark, large + sparse)
    got = {}
    for r in comps.comparables(s, pool, 5).collect():
        got.setdefault(r["subject_id"], []).append((r["rank"], r["asset_id"]))
    want = brute(subs, large + sparse, 5)
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == {k: [x[1] for x in v] for k, v in want.items()}


def test_join_guard_survives_pruning(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    once = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "id string, y int")
    assert {tuple(r) for r in lookup.join_keeping_all(left, once, "id").collect()} == {("a", 1, 5), ("b", 2, 6)}
    for bad in (once.filter("id <> 'b'"), once.unionByName(once.filter("id = 'a'"))):
        joined = lookup.join_keeping_all(left, bad, "id")
        for use in (joined.count, joined.select("x").collect, joined.select("y").collect):
            with pytest.raises(Exception, match="partner"):
                use()


def test_checks_on_empty_input(spark, sf):
    listings = curate.curated(spark, sf).limit(0)
    rules = quality.check(listings, (1, 10)).collect()
    assert len(rules) == 12 and not {r["rule"]: r["ok"] for r in rules}["row_count_in_bounds"]
    assert all(r["null_rate"] is None for r in quality.null_rates(listings).collect())
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert evaluate.roc_auc(one, "y", "s").first()["auc"] is None


def test_scores_can_be_written_and_read(spark, sf, tmp_path):
    scored = models.score(curate.curated(spark, sf), modelling.bundle(spark, sf))
    scored.write.parquet(str(tmp_path / "scores"))
    back = spark.read.parquet(str(tmp_path / "scores"))
    assert back.count() == curate.curated(spark, sf).count() > 0
    assert back.filter("low <= estimate and estimate <= high").count() == back.count()
