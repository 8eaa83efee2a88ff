"""Invariants of the fitted models and their attributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.functions import treeshap
from estate_spark.operators import curate, explain, models
from estate_spark.plans import QUERIES
from estate_spark.plans.modelling import bundle


@pytest.fixture(scope="module")
def scored(spark, sf):
    return models.score(curate.curated(spark, sf), bundle(spark, sf))


def test_band_holds_estimate(scored, spark, sf):
    assert scored.filter("not (low <= estimate and estimate <= high)").count() == 0
    assert scored.count() == curate.curated(spark, sf).count()


def test_posted_rows_can_be_scored(spark, sf):
    """Unknown levels, missing features and extra columns do not stop a score."""
    from estate_spark.functions import rules
    posted = spark.createDataFrame([("p1", 80.0, "castle", 0.9)], "asset_id string, area_m2 double, property_type string, cnn_condition_score double")
    out = models.score(rules.align(posted, C.feature_roles().usable, C.TYPES, ["asset_id"]), bundle(spark, sf)).collect()
    assert len(out) == 1 and out[0]["low"] <= out[0]["estimate"] <= out[0]["high"]


def test_shap_adds_up(spark, sf):
    b = bundle(spark, sf)
    rows = explain.shap_rows(curate.curated(spark, sf), b)
    feats = explain.explained_features(rows)
    assert feats == C.feature_roles().usable
    total = sum((F.col(explain.PREFIX + f) for f in feats), F.col("base_value"))
    worst = rows.agg(F.max(F.abs(total - F.col("prediction")) / F.abs("prediction"))).first()[0]
    assert worst < 1e-6


def test_shap_against_subset_enumeration():
    """Exact Shapley values of one hand-made tree by enumerating all coalitions."""
    from itertools import combinations
    from math import factorial
    node = lambda i, l, r, v, n, f=-1, t=0.0: {"id": i, "leftChild": l, "rightChild": r, "prediction": v, "rawCount": n,
                                               "split": {"featureIndex": f, "leftCategoriesOrThreshold": [t], "numCategories": -1}}
    nodes = [node(0, 1, 2, 0, 100, 0, 5.0), node(1, 3, 4, 0, 60, 1, 2.0), node(2, 5, 6, 0, 40, 0, 8.0),
             node(3, -1, -1, 10.0, 20), node(4, -1, -1, 30.0, 40), node(5, -1, -1, 50.0, 30), node(6, -1, -1, 90.0, 10)]
    leaves = treeshap.leaves_of(nodes, 1.0)

    def value(x, known, i=0):
        n = nodes[i]
        if n["leftChild"] < 0:
            return n["prediction"]
        f, t = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        l, r = n["leftChild"], n["rightChild"]
        if f in known:
            return value(x, known, l if x[f] <= t else r)
        return (nodes[l]["rawCount"] * value(x, known, l) + nodes[r]["rawCount"] * value(x, known, r)) / n["rawCount"]

    x = np.array([[4.0, 1.0], [4.0, 3.0], [6.0, 1.0], [9.0, 9.0]])
    phi = treeshap.contributions(x, leaves)
    for row, got in zip(x, phi):
        for i in range(2):
            others = [j for j in range(2) if j != i]
            want = sum(factorial(len(s)) * factorial(1 - len(s)) / 2 * (value(row, set(s) | {i}) - value(row, set(s)))
                       for k in range(2) for s in combinations(others, k))
            assert got[i] == pytest.approx(want)
        assert treeshap.expected_value(leaves) + got.sum() == pytest.approx(value(row, {0, 1}))


def random_tree(rng, depth, features=12, levels=5):
    """Nodes as Spark ML stores them: the first third of the features is categorical, features repeat on a path."""
    nodes = []

    def grow(count, left):
        i = len(nodes)
        nodes.append({"id": i, "leftChild": -1, "rightChild": -1, "prediction": float(rng.normal()), "rawCount": count,
                      "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}})
        if left and count > 1 and (left == depth or rng.random() < 0.95):
            f = int(rng.integers(features))
            some = f < features // 3
            nodes[i]["split"] = {"featureIndex": f, "numCategories": levels if some else -1, "leftCategoriesOrThreshold":
                                 sorted(rng.choice(levels, 2, replace=False).astype(float).tolist()) if some else [float(rng.random())]}
            part = int(rng.integers(1, count))
            nodes[i]["leftChild"] = grow(part, left - 1)
            nodes[i]["rightChild"] = grow(count - part, left - 1)
        return i

    grow(100_000, depth)
    return nodes


@pytest.mark.parametrize("depth", [0, 1, 6, 10])
def test_tree_kernel_equals_the_plain_form(depth):
    rng = np.random.default_rng(depth)
    x = rng.random((300, 12))
    x[:, :4] = rng.integers(0, 5, (300, 4))
    trees = [random_tree(rng, depth) for _ in range(4)]
    fast = [treeshap.tree_of(t, 0.5 + i) for i, t in enumerate(trees)]
    plain = [leaf for i, t in enumerate(trees) for leaf in treeshap.leaves_of(t, 0.5 + i)]
    got = treeshap.ensemble_contributions(x, fast)
    assert np.allclose(got, treeshap.contributions(x, plain), atol=1e-9)
    assert treeshap.ensemble_expected(fast) == pytest.approx(treeshap.expected_value(plain))
    assert treeshap.ensemble_contributions(x[:0], fast).shape == (0, 12)


def test_importance_sums_to_one(spark, sf):
    rows = QUERIES["importance_shares"](spark, sf).collect()
    assert sum(r["share"] for r in rows) == pytest.approx(1.0) and not any(r["suspicious"] for r in rows)


def test_cache_serves_only_its_own_run(spark, sf):
    rows = curate.curated(spark, sf).select("asset_id")
    cache = rows.select("asset_id", F.lit(1.0).alias("prediction"), F.lit("old").alias("run_id"))
    out = explain.cache_or_compute(rows, cache, lambda d: d.withColumn("prediction", F.lit(2.0)), "new")
    assert out.filter("from_cache or prediction <> 2.0").count() == 0 and out.count() == rows.count()


def test_cached_equals_direct(spark, sf):
    direct = models.score(curate.curated(spark, sf), bundle(spark, sf)).select("asset_id", "estimate")
    cached = QUERIES["shap_cache"](spark, sf)
    both = direct.join(cached, "asset_id")
    assert both.filter(F.abs(F.col("estimate") - F.col("prediction")) > 1e-6).count() == 0
    assert {r[0] for r in both.select("from_cache").distinct().collect()} == {True, False}


def test_out_of_fold_scores_cover_all_rows(spark, sf):
    from pyspark.sql import functions as F2
    p = QUERIES["probe_oof"](spark, sf)
    assert p.count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert p.filter("score is null or score < 0 or score > 1").count() == 0
    assert p.groupBy("row_id").agg(F2.count("*").alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize("depth, kinds", [(6, 39), (6, 3), (4, 9), (9, 12), (1, 5), (0, 5)])
def test_branch_tables_equal_the_plain_form(depth, kinds, monkeypatch):
    """Leaves read one by one, by small branches and by whole trees, with features met again."""
    rng = np.random.default_rng(depth * 100 + kinds)

    def grow(nodes, d, n):
        i = len(nodes)
        nodes.append({"id": i, "leftChild": -1, "rightChild": -1, "prediction": float(rng.normal()), "rawCount": n, "split": None})
        if d and n >= 4 and (d == depth or rng.random() > 0.1):
            f, left = int(rng.integers(kinds)), max(1, int(n * rng.uniform(0.2, 0.8)))
            nodes[i]["split"] = {"featureIndex": f, "leftCategoriesOrThreshold": [0.0, 2.0, 5.0] if f % 5 == 4 else [float(rng.normal())],
                                 "numCategories": 8 if f % 5 == 4 else -1}
            nodes[i]["leftChild"] = grow(nodes, d - 1, left)
            nodes[i]["rightChild"] = grow(nodes, d - 1, n - left)
        return i

    trees = [[] for _ in range(4)]
    for nodes in trees:
        grow(nodes, depth, 5000)
    x = rng.normal(size=(300, 39))
    x[:, 4::5] = rng.integers(0, 8, size=x[:, 4::5].shape)
    want = sum(treeshap.contributions(x, treeshap.leaves_of(nodes, 0.1)) for nodes in trees)
    for splits in (0, 1, 3, 7, 12):
        monkeypatch.setattr(treeshap, "BRANCH_SPLITS", splits)
        assert np.allclose(treeshap.ensemble_contributions(x, [treeshap.tree_of(nodes, 0.1) for nodes in trees]), want, atol=1e-12)


def test_rows_gathered_over_batches_keep_their_answers(spark, sf, monkeypatch):
    rows, b = curate.curated(spark, sf), bundle(spark, sf)
    want = {r["asset_id"]: r for r in explain.shap_rows(rows, b).collect()}
    monkeypatch.setattr(explain, "SHAP_ROWS", 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r["asset_id"]: r for r in explain.shap_rows(rows.coalesce(1), b).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) == rows.count()
    assert all(np.allclose(got[k][1:], want[k][1:], rtol=1e-9, atol=1e-6) for k in want)
