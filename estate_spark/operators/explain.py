"""Per-row contributions, drivers, their texts, global importance and the cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.functions import treeshap
from estate_spark.functions.labels import describe
from estate_spark.functions.text import format_eur
from estate_spark.operators import boost, features, models
from estate_spark.session import grown, scratch_path

# the one function that runs in Python workers travels with the job, so executors need no
# copy of this package
cloudpickle.register_pickle_by_value(treeshap)

PREFIX = "shap__"
TOP_N = 5                        # fixed value
SHAP_ROWS = 40_000               # rows that share a tree's tables; a few copies of their vectors are held


def ensemble_trees(model, spark) -> list[treeshap.Tree]:
    """Trees of a boosted model, read from the model's own saved tables: its size is set by
    the training parameters, not by the data."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    weights = model.treeWeights
    trees: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(r["treeID"], []).append(r["nodeData"].asDict(recursive=True))
    return [treeshap.tree_of(nodes, float(weights[t])) for t, nodes in sorted(trees.items())]


def shap_rows(df: DataFrame, bundle: models.Bundle, key: str = "asset_id") -> DataFrame:
    """key, shap__<feature> x 38, base_value, prediction. Tree values need a per-row walk
    over the model, so Arrow batches go through NumPy; partitions stay where they are."""
    trees = ensemble_trees(bundle.point, df.sparkSession)
    base = treeshap.ensemble_expected(trees)
    shared = df.sparkSession.sparkContext.broadcast(trees)
    names, contributions = bundle.names, treeshap.ensemble_contributions

    at_once = SHAP_ROWS

    def answered(held: list[pd.DataFrame]) -> pd.DataFrame:
        b = pd.concat(held, ignore_index=True)
        phi = contributions(np.stack(b["x"].to_numpy()), shared.value)
        return pd.DataFrame({key: b[key], "prediction": b["prediction"], "phi": list(phi)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= at_once:
                yield answered(held)
                held = []
        if sum(map(len, held)):
            yield answered(held)

    x = boost.predict(models.assemble(df, bundle.prep), prediction=bundle.point).select(
        key, "prediction", vector_to_array(F.col(models.VECTOR)).alias("x"))
    out = x.mapInPandas(run, f"{key} string, prediction double, phi array<double>")
    slot = {n: F.col("phi")[i] for i, n in enumerate(names)}
    # the missing-year indicator is part of the year's effect
    slot[features.YEAR_SOURCE] = slot[features.YEAR_SOURCE] + slot.pop(features.YEAR_MISSING)
    return out.select(key, *[slot[f].alias(PREFIX + f) for f in C.feature_roles().usable],
                      F.lit(base).alias("base_value"), "prediction")


def linear_rows(df: DataFrame, coefs: dict[str, float], means: dict[str, float], intercept: float,
                key: str = "asset_id") -> DataFrame:
    """The same layout for a linear model: coef * (x - mean), 0 for a missing value."""
    parts = {f: F.coalesce(F.lit(c) * (F.col(f) - F.lit(means[f])), F.lit(0.0)) for f, c in coefs.items()}
    total = F.lit(intercept)
    for p in parts.values():
        total = total + p
    return df.select(key, *[p.alias(PREFIX + f) for f, p in parts.items()],
                     F.lit(intercept).alias("base_value"), total.alias("prediction"))


def explained_features(shap: DataFrame) -> list[str]:
    return [c[len(PREFIX):] for c in shap.columns if c.startswith(PREFIX)]


def drivers_of(feats: list[str], n: int = TOP_N) -> Column:
    """The n features of largest absolute contribution, ties in feature order, as structs of
    feature, value, shap_eur, description. Needs the raw feature columns on the row."""
    items = F.array(*[F.struct(
        (-F.abs(F.col(PREFIX + f))).alias("order"), F.lit(i).alias("pos"), F.lit(f).alias("feature"),
        F.col(f).cast("string").alias("value"), F.col(PREFIX + f).alias("shap_eur"),
        describe(f, F.col(f), F.col("neighborhood_name")).alias("description")) for i, f in enumerate(feats)])
    return F.transform(F.slice(F.sort_array(items), 1, n), lambda d: F.struct(
        d["feature"].alias("feature"), d["value"].alias("value"), d["shap_eur"].alias("shap_eur"),
        d["description"].alias("description")))


def driver_text(estimate: Column, drivers: Column) -> Column:
    clauses = F.transform(drivers, lambda d: F.concat(
        d["description"], F.when(d["shap_eur"] >= 0, " adds ").otherwise(" subtracts "),
        format_eur(F.abs(d["shap_eur"])), F.lit(" euros")))
    body = F.array_join(clauses, ", ")
    body = F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)))
    return F.concat(F.lit("Estimated value is "), format_eur(estimate), F.lit(" euros. "), body, F.lit("."))


def explain(listings: DataFrame, shap: DataFrame, n: int = TOP_N, key: str = "asset_id") -> DataFrame:
    """key, estimate, base_value, top_drivers, driver_text."""
    feats = explained_features(shap)
    raw = listings.select(key, "neighborhood_name", *[f for f in feats if f != "neighborhood_name"])
    out = shap.join(grown(raw), key).withColumn("top_drivers", drivers_of(feats, n))
    return out.select(key, F.col("prediction").alias("estimate"), "base_value", "top_drivers",
                      driver_text(F.col("prediction"), F.col("top_drivers")).alias("driver_text"))


def global_importance(shap: DataFrame) -> DataFrame:
    """feature, mean_abs_shap, share: all features in one aggregate pass."""
    feats = explained_features(shap)
    one = shap.agg(*[F.avg(F.abs(PREFIX + f)).alias(f) for f in feats])
    total = sum((F.col(f) for f in feats), F.lit(0.0))
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap"),
        F.when(total > 0, F.try_divide(F.col(f), total)).otherwise(0.0).alias("share")) for f in feats])).alias("r")
    ).select("r.*").orderBy(F.col("mean_abs_shap").desc(), "feature")


def cache_or_compute(wanted: DataFrame, cache: DataFrame, compute, run_id: str, key: str = "asset_id") -> DataFrame:
    """Cached rows of this model run where present, computed ones elsewhere, with
    ``from_cache``. The cache is keyed by run, so that an estimate and its interval never
    come from two different models."""
    mine = cache.filter(F.col("run_id") == run_id).drop("run_id")
    hits = mine.join(grown(wanted.select(key)), key, "left_semi").withColumn("from_cache", F.lit(True))
    missing = wanted.join(grown(mine.select(key)), key, "left_anti")
    return hits.unionByName(compute(missing).withColumn("from_cache", F.lit(False)))
