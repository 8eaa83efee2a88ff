"""Boosting: patience, steps of both losses, what signal and noise give, and the stored band."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from estate_spark.operators import boost, curate, evaluate, models
from estate_spark.plans.modelling import bundle


@pytest.mark.parametrize("curve, patience, best", [
    ([5, 4, 3], 2, None), ([5, 4, 4, 4], 2, 1), ([5, 4, 4, 3, 9, 9], 2, 3), ([5, 6, 7, 1], 2, 0), ([1], 1, None), ([3, 2, 2, 2, 2, 1], 3, 1)])
def test_patience(curve, patience, best):
    assert boost.rounds_left(curve, patience) == best


@pytest.fixture(scope="module")
def steps_data(spark):
    """A step function of one feature with noise whose width follows a second one."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        a, b = rng.random(), rng.random()
        rows.append((a, b, 100.0 * (a > 0.5) + 10.0 * (0.2 + b) * rng.gauss(0, 1), i % 5 == 0))
    df = spark.createDataFrame(rows, "a double, b double, y double, held boolean").repartition(4)
    return VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df).persist()


def test_squared_loss_learns_and_keeps_the_best_round(steps_data):
    b = boost.boost(steps_data, "y", "x", F.col("held"), rate=0.3, depth=2, patience=6)
    best = int(np.argmin(b.curve))
    assert b.best == best == len(b.trees.trees) - 1 and len(b.curve) - 1 >= best + 6 and b.curve[best] < 0.05 * b.curve[0]
    got = b.apply(steps_data.filter("held"), "p").agg(F.avg((F.col("y") - F.col("p")) ** 2)).first()[0]
    assert got == pytest.approx(b.curve[best], rel=1e-9)


@pytest.mark.parametrize("alpha", [0.05, 0.95])
def test_pinball_loss_learns_quantiles(steps_data, alpha):
    b = boost.boost(steps_data, "y", "x", F.col("held"), alpha, rate=0.3, depth=3, least_rows=50, patience=6)
    p = b.apply(steps_data, "p").filter("held")
    one = p.agg(F.avg((F.col("y") <= F.col("p")).cast("double")).alias("share"), F.avg(boost.loss(F.col("y"), F.col("p"), alpha)).alias("loss")).first()
    assert one["share"] == pytest.approx(alpha, abs=0.03)
    assert one["loss"] == pytest.approx(b.curve[b.best], rel=1e-9) and b.curve[b.best] < 0.4 * b.curve[0]


def test_first_step_of_a_leaf_is_its_residual_quantile(steps_data):
    b = boost.boost(steps_data, "y", "x", F.col("held"), 0.9, rate=1.0, depth=1, limit=1)
    rows = [(r["x"][0], r["x"][1], r["y"]) for r in steps_data.filter("not held").collect()]
    node = b.trees.trees[1].toDebugString
    cut = float(node.split("<= ")[1].split(")")[0])
    f = int(node.split("feature ")[1].split(" ")[0])
    base = np.quantile([y for *_, y in rows], 0.9)
    assert b.base == pytest.approx(base)
    for leaf, side in enumerate(([r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut])):
        assert b.steps[0][leaf] == pytest.approx(np.quantile([r[2] - base for r in side], 0.9))


def test_without_held_rows_or_rows(spark, steps_data):
    b = boost.boost(steps_data.filter("not held"), "y", "x", F.col("held"), rate=0.3, depth=2, limit=3)
    assert b.best == 3 and b.curve == []
    constant = steps_data.withColumn("y", F.when(F.col("a") > 0, 7.0))
    c = boost.boost(constant, "y", "x", F.col("held"), 0.5, patience=2)
    assert {r["p"] for r in c.apply(constant, "p").select("p").distinct().collect()} == {7.0}


def test_band_of_the_bundle(spark, sf):
    """Nominal coverage within what the split sizes allow, and wider for dearer estimates."""
    b, rows = bundle(spark, sf), curate.curated(spark, sf)
    assert b.rounds["point"]["run"] >= b.rounds["point"]["best"] + boost.PATIENCE
    scored = models.score(rows, b, ["asset_id", "price"])
    from estate_spark.plans.sampling import split
    test = scored.join(split(spark, sf).filter("split = 'test'"), "asset_id", "left_semi").cache()
    n = test.count()
    covered = evaluate.coverage(test, "price", "low", "high").first()["coverage"]
    assert covered == pytest.approx(b.test_coverage)
    assert abs(covered - 0.90) <= max(0.02, 3 * (0.09 * 2.25 / n) ** 0.5)      # calibration and test rows both vary
    assert test.filter("not (low <= estimate and estimate <= high)").count() == 0
