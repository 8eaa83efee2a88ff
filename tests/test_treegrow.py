"""Trees grown by counts a task against Spark's own trees, plain quantiles and plain sums."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from estate_spark.functions import treegrow
from estate_spark.operators import boost


@pytest.fixture(scope="module")
def mixed(spark):
    """Few-valued numbers, flags and a category, so that Spark's trees see the same bins; most rows in one task."""
    rng = random.Random(8)
    rows = [(float(rng.randrange(20)), float(rng.randrange(2)), float(rng.random() < 0.01), rng.choice("abcde"), rng.gauss(0, 1), i % 4 == 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, f double, g double, c string, e double, held boolean").withColumn(
        "y", F.col("a") * F.when(F.col("c") == "b", 3).otherwise(1) + 5 * F.col("f") + F.col("e")).repartition(3)
    x = StringIndexerModel.from_labels(list("abcd"), inputCol="c", outputCol="ci", handleInvalid="keep").transform(df)
    return VectorAssembler(inputCols=["a", "f", "g", "ci"], outputCol="x").transform(x).persist()


@pytest.mark.parametrize("part_rows", [10 ** 6, 700])
def test_first_tree_is_sparks(mixed, monkeypatch, part_rows):
    monkeypatch.setattr(boost, "PART_ROWS", part_rows)
    monkeypatch.setattr(boost, "FEW_PARTS", 4)
    fitted = mixed.filter("not held")
    mean = fitted.agg(F.avg("y")).first()[0]
    want = DecisionTreeRegressor(featuresCol="x", labelCol="r", maxDepth=4, minInstancesPerNode=20, seed=1).fit(fitted.withColumn("r", F.col("y") - mean))
    got = boost.boost(mixed, "y", "x", F.col("held"), depth=4, rate=1.0, limit=1)
    tree = got.trees.trees[1]
    assert (tree.depth, tree.numNodes) == (want.depth, want.numNodes)
    assert np.allclose(tree.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-9)
    both = want.setPredictionCol("w").transform(got.apply(mixed, "p")).select("w", (F.col("p") - mean).alias("p")).toPandas()
    assert np.allclose(both.w, both.p, atol=1e-9)


def test_models_together_are_the_models_alone(mixed):
    alphas = [None, 0.1, 0.9]
    joint = boost.boost_all(mixed, "y", "x", F.col("held"), alphas, depth=3, limit=12, patience=4)
    for alpha, one in zip(alphas, joint):
        alone = boost.boost(mixed, "y", "x", F.col("held"), alpha, depth=3, limit=12, patience=4)
        assert one.curve == pytest.approx(alone.curve) and one.best == alone.best
        p = one.apply(alone.apply(mixed, "alone"), "joint").agg(F.max(F.abs(F.col("alone") - F.col("joint")))).first()[0]
        assert p < 1e-9


def test_steps_are_leaf_quantiles(mixed, monkeypatch):
    """Windows of no width are asked again until they reach the place."""
    asked = []
    run = treegrow.windows
    monkeypatch.setattr(boost, "WIDTH", 1e-9)
    monkeypatch.setattr(boost, "PART_ROWS", 500)
    monkeypatch.setattr(boost, "_ask", lambda chunks, what, add, _ask=boost._ask, **k: (asked.append(what is run), _ask(chunks, what, add, **k))[1])
    b = boost.boost(mixed, "y", "x", F.col("held"), 0.9, depth=3, rate=0.5, limit=1)
    assert sum(asked) > 1
    leaf = b.trees.trees[1].setLeafCol("leaf").setPredictionCol("step").transform(mixed.filter("not held"))
    rows = leaf.select(F.col("leaf").cast("int").alias("k"), "step", (F.col("y") - b.base).alias("r")).toPandas()
    for k, own in rows.groupby("k"):
        assert b.steps[0][k] == pytest.approx(np.quantile(own.r, 0.9)) and (own.step == b.steps[0][k]).all()


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile_from_windows_is_exact_or_refused(alpha):
    rng = np.random.default_rng(5)
    values = [np.sort(rng.integers(0, 50, n) * 1.0 + shift) for n, shift in ((400, 0), (900, 3), (1, 9), (300, 40))]
    want = np.quantile(np.concatenate(values), alpha)
    kept = []
    for spare in (1, 5, 60, 2000):
        parts = []
        for v in values:
            at = (len(v) - 1) * alpha
            lo, hi = max(0, int(at) - spare), min(len(v) - 1, int(np.ceil(at)) + spare)
            parts.append((0, len(v), lo, v[lo:hi + 1]))
        kept.append(treegrow.quantile_of(parts, alpha))
    assert kept[-1] == pytest.approx(want) and all(k is None or k == pytest.approx(want) for k in kept)


def test_counts_of_shared_columns():
    """Features that share a column, a wide category and a constant one, against counts a feature."""
    rng = np.random.default_rng(2)
    cuts = [np.arange(31.0), np.array([0.5]), np.array([0.5]), None, np.array([]), None]
    layout = treegrow.Layout(cuts, [32, 2, 2, 700, 1, 5])
    n, fit = 5000, 3500
    x = np.stack([rng.normal(15, 9, n), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(0, 700, n), np.ones(n), rng.integers(0, 5, n)], axis=1)
    codes, miss = layout.encode(x), rng.normal(size=(2, n))
    assert codes.dtype == np.uint16 and layout.widths == [700, 160, 4]
    root = (0, np.zeros(1, dtype=np.intp), np.zeros((1, 1), dtype=np.uint8)), np.zeros(1, dtype=np.intp), 1, False
    got = treegrow.count_codes([(0, (codes, fit, miss))], layout, [(0, None, *root), (1, 0.1, *root)])
    for (rows, sums, squares), g in zip(got, (miss[0, :fit], np.where(miss[1, :fit] > 0, 0.1, -0.9))):
        assert rows[0, -1] == fit and sums[0, -1] == pytest.approx(g.sum()) and squares == pytest.approx(g @ g)
        for f, size in enumerate(layout.sizes):
            bins = x[:fit, f].astype(int) if cuts[f] is None else (x[:fit, f][:, None] > cuts[f]).sum(1)
            a = layout.starts[f]
            if size > 1:
                assert (rows[0, a:a + size] == np.bincount(bins, minlength=size)).all()
                assert np.allclose(sums[0, a:a + size], np.bincount(bins, weights=g, minlength=size))
    with pytest.raises(ValueError):
        layout.encode(np.array([[1.0, 0, 0, 700, 1, 0]]))


def test_thresholds_come_from_all_rows():
    """Few values are all told apart, a rare one too; many are cut into parts of about equal weight."""
    few = treegrow.cuts_of(*treegrow.weighted(np.array([1.0] * 9999 + [0.0] * 50_000 + [7.0]), np.ones(60_000), 100, 100), 32)
    assert few.tolist() == [0.5, 4.0]
    rng = np.random.default_rng(1)
    parts = [rng.normal(i, 1, 30_000) for i in range(4)]
    found = treegrow.merged([[treegrow.weighted(v, np.ones(len(v)), 2048, 2048)] for v in parts])
    cuts = treegrow.cuts_of(*found[0], 32)
    share = np.diff(np.searchsorted(np.sort(np.concatenate(parts)), cuts)) / 120_000
    assert len(cuts) == 31 and abs(share - 1 / 32).max() < 0.003
    close = np.array([1.0, np.nextafter(1.0, 2.0)])
    assert treegrow.cuts_of(close, np.ones(2), 32).tolist() == [1.0]


def test_a_round_is_a_job_a_level(mixed, monkeypatch):
    """All models share their jobs: the root, the levels below it and the quantiles."""
    asked = []
    monkeypatch.setattr(boost, "_ask", lambda chunks, what, add, _ask=boost._ask, **k: (asked.append(what.__name__), _ask(chunks, what, add, **k))[1])
    boost.boost_all(mixed, "y", "x", F.col("held"), [None, 0.05, 0.95], depth=4, limit=5, patience=50)
    assert asked.count("first_counts") == 6 and asked.count("count_codes") <= 5 * 3 and asked.count("windows") <= 5 * 2
    assert mixed.select(F.max(F.size(vector_to_array("x")))).first()[0] == 4


def test_empty_parts_and_no_rows(mixed):
    with pytest.raises(ValueError):
        boost.boost(mixed.filter("held"), "y", "x", F.col("held"))
    one = boost.boost(mixed.limit(1).withColumn("held", F.lit(False)), "y", "x", F.col("held"), 0.5, limit=3)
    assert one.best == 1 and one.apply(mixed.limit(1), "p").first()["p"] == pytest.approx(one.base)


def test_predictions_are_those_of_spark(mixed):
    """Stored ensembles in Arrow batches against Spark's own walk: numbers, categories, levels unseen in training, one model or two."""
    point, low = boost.boost_all(mixed, "y", "x", F.col("held"), [None, 0.2], depth=5, rate=0.3, limit=6)
    edge = mixed.unionByName(mixed.limit(50).withColumn("e", F.lit(0.0)))
    x = boost.predict(edge, point=point.trees, low=low.trees)
    for out, b in (("point", point), ("low", low)):
        x = b.trees.setPredictionCol(f"{out}_spark").setLeafCol("").transform(x)
    worst = x.agg(*[F.max(F.abs(F.col(c) - F.col(f"{c}_spark"))) for c in ("point", "low")], F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2] == 6050
    steps = boost.predict_steps(mixed, low.trees, low.base, low.steps, low.rate, "beside")
    assert boost.predict(steps, low=low.trees).agg(F.max(F.abs(F.col("low") - F.col("beside")))).first()[0] < 1e-9
