"""The bucketed paths give the same exact results as the small ones."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_spark.operators import energy, evaluate, explore, drift, ranks, sampling
from estate_spark.operators import curate


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, heavy ties, nulls and NaN."""
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 40}"
        v = 5.0 if i % 7 == 0 else float((i * 7919) % 1013) / 10
        rows.append((i, g, None if i % 101 == 0 else float("nan") if i % 103 == 0 else v, float(i % 13)))
    return spark.createDataFrame(rows, "id long, g string, v double, w double").persist()


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_quantiles_small_equals_bucketed(skewed, method):
    a = ranks.quantile_rows(skewed, ["v", "w"], [0.0, 0.01, 0.5, 0.95, 1.0], ["g"], method, small=True)
    b = ranks.quantile_rows(skewed, ["v", "w"], [0.0, 0.01, 0.5, 0.95, 1.0], ["g"], method, small=False)
    key = lambda r: (r["g"], r["series"])
    ra, rb = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert [tuple(r)[:3] for r in ra] == [tuple(r)[:3] for r in rb]
    for x, y in zip(ra, rb):
        assert np.allclose(tuple(x)[3:], tuple(y)[3:], rtol=1e-12)


def test_medians_against_python(skewed):
    got = {r["g"]: r["v"] for r in ranks.medians(skewed, ["v"], ["g"], small=False).collect()}
    ref = {}
    for r in skewed.collect():
        if r["v"] is not None and r["v"] == r["v"]:
            ref.setdefault(r["g"], []).append(r["v"])
    assert got.keys() == ref.keys()
    for g, vs in ref.items():
        assert got[g] == pytest.approx(statistics.median(vs))


def test_nearest_rank_rounds_half_up(spark):
    df = spark.createDataFrame([(float(i),) for i in (10, 20, 30, 40)], "v double")
    r = ranks.quantile_rows(df, ["v"], [0.5], method="nearest", small=True).first()
    assert r["q0_5"] == 30.0          # (n-1)q = 1.5 -> element 2


def test_nan_does_not_shift_a_median(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    for small in (True, False):
        assert ranks.medians(df, ["v"], small=small).first()["v"] == 2.0


@pytest.mark.parametrize("small", [True, False])
def test_kth_smallest(skewed, small):
    vs = sorted(r["w"] for r in skewed.collect())
    r = ranks.kth_smallest(skewed, "w", F.lit(1234), small).first()
    assert (r["n"], r["kth"]) == (len(vs), vs[1233])


def test_hash_rank_is_a_permutation_per_class(skewed):
    out = ranks.hash_rank(skewed.select("id", "g").withColumn("id", F.col("id").cast("string")), "id", 42, ["g"]).collect()
    per = {}
    for r in out:
        per.setdefault(r["g"], []).append(r["hash_rank"])
        assert r["class_rows"] > 0
    for ranks_of in per.values():
        assert sorted(ranks_of) == list(range(len(ranks_of)))


def test_auc_and_ap_both_paths(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.random(500) * 0.6 + 0.2 * y, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    cuts = sorted(set(s), reverse=True)
    ap = last = 0.0
    for c in cuts:
        tp, n = ((s >= c) & (y == 1)).sum(), (s >= c).sum()
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    for small in (True, False):
        assert evaluate.roc_auc(df, "y", "s", small).first()["auc"] == pytest.approx(auc)
        assert evaluate.average_precision(df, "y", "s", small).first()["average_precision"] == pytest.approx(ap)


def test_drift_paths_agree_and_flag(spark, sf):
    ref = curate.curated(spark, sf)
    cur = ref.withColumn("area_m2", F.col("area_m2") * 3)
    a = {r["feature"]: r for r in drift.drift_table(ref, cur, small=True).collect()}
    b = {r["feature"]: r for r in drift.drift_table(ref, cur, small=False).collect()}
    assert a.keys() == b.keys()
    for f in a:
        assert a[f]["psi"] == pytest.approx(b[f]["psi"], abs=1e-9)
        assert a[f]["ks_statistic"] == pytest.approx(b[f]["ks_statistic"])
    assert a["area_m2"]["drifted"] and a["area_m2"]["psi"] > 0.2 and a["area_m2"]["ks_p_value"] < 0.05
    assert [f for f in a if a[f]["drifted"]] == ["area_m2"]
    assert all(abs(r["psi"]) < 1e-9 and r["ks_statistic"] == 0 for r in a.values() if r["feature"] != "area_m2")


def test_drift_empty_side_is_not_drift(spark, sf):
    ref = curate.curated(spark, sf)
    t = drift.drift_table(ref, ref.limit(0), small=True)
    assert t.filter("drifted or not isnan(psi) or not isnan(ks_statistic)").count() == 0


def test_psi_constant_feature_is_zero(spark):
    ref = spark.createDataFrame([(1.0,)] * 5, "v double")
    cur = spark.createDataFrame([(9.0,)] * 5, "v double")
    assert drift.psi(ref, cur, ["v"], small=True).first()["psi"] == 0.0


def test_market_summaries_both_paths(spark, sf):
    df = curate.curated(spark, sf)
    for fn in (lambda s: explore.group_medians(df, small=s), lambda s: explore.histogram(df, "price", 40, s),
               lambda s: explore.kpi_delta(df, F.col("price") > 150000, s),
               lambda s: energy.segment_stats(df, ["neighborhood_id"], s), lambda s: energy.segment_stats(df, [], s)):
        key = lambda r: str(r[0])
        for x, y in zip(sorted(fn(True).collect(), key=key), sorted(fn(False).collect(), key=key), strict=True):
            for u, v in zip(x, y, strict=True):
                assert u == v or u == pytest.approx(v)


def test_stratified_sample_quota_and_limit(spark):
    rows = [(f"t{i}", 1 if i % 3 == 0 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "tile_id string, label int")
    s = sampling.stratified_sample(df, "tile_id", "label", 10).collect()
    assert len(s) == 10           # quotas ceil(3.4) + ceil(6.6) = 11, then cut to 10
    assert sampling.stratified_sample(df, "tile_id", "label", 1000).count() == 100


def test_split_sizes(spark):
    df = spark.createDataFrame([(f"A{i}",) for i in range(1003)], "asset_id string")
    n = {r["split"]: r["count"] for r in sampling.split_3way(df).groupBy("split").count().collect()}
    assert n == {"test": 201, "val": 161, "train": 641}


def test_split_is_independent_of_partitioning(spark):
    df = spark.createDataFrame([(f"A{i}",) for i in range(500)], "asset_id string")
    a = sorted(map(tuple, sampling.split_3way(df.repartition(1)).collect()))
    b = sorted(map(tuple, sampling.split_3way(df.repartition(7)).collect()))
    assert a == b


def test_quantiles_between_equal_values_are_that_value(spark):
    """x (1 - s) + x s may differ from x in the last bit, which moves all its rows to another bin."""
    values = [40.3028, -3.7411, 40.5127, -3.6649, 0.1, 40.4113]
    rows = spark.createDataFrame([(str(v), v) for v in values for _ in range(8)], "g string, v double")
    qs = [i / 10 for i in range(11)]
    assert any(v * (1 - s) + v * s != v for v in values for p in qs[1:] for s in [7 * p - int(7 * p)])
    for r in ranks.quantile_rows(rows, ["v"], qs, ["g"], small=False).collect():
        assert set(r[3:]) == {float(r["g"])}
    one = spark.createDataFrame([(v,) for v in values[:1] * 8], "v double")
    edges = drift.ref_quantiles(drift.ranked(drift.state(one, one, ["v"])), qs).first()["q"]
    assert set(edges) == {values[0]}
