"""Trained bundles and splits on disk, and the log of training runs that points to them."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.operators import features, lookup
from estate_spark.operators.models import Bundle

_PLAIN = ["names", "quantiles", "calibration_q", "test_coverage", "test_metrics", "rounds", "run_id"]
_MODELS = ["point", "low", "high"]


def save_bundle(spark: SparkSession, bundle: Bundle, root: str, run_name: str = "tabular", production: bool = False,
                params: dict[str, str] | None = None) -> str:
    """Write the models and their preparation under ``root`` and append a row to its run log;
    returns the bundle's path. The same run is stored once."""
    path = f"{root}/bundles/{bundle.run_id}"
    for name in _MODELS:
        getattr(bundle, name).write().overwrite().save(f"{path}/{name}")
    state = {k: getattr(bundle, k) for k in _PLAIN} | {"prep": asdict(bundle.prep)}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
    metrics = {k: float(v) for k, v in bundle.test_metrics.items() if v is not None} | {
        "coverage": bundle.test_coverage, "calibration_q": bundle.calibration_q}
    row = spark.range(1).select(
        F.lit(bundle.run_id).alias("run_id"), F.lit(run_name).alias("run_name"), F.current_timestamp().alias("start_time"),
        F.lit(production).alias("is_production"), F.from_json(F.lit(json.dumps(params or {})), "map<string,string>").alias("params"),
        F.from_json(F.lit(json.dumps(metrics)), "map<string,double>").alias("metrics"))
    lookup.append_run(row, f"{root}/runs")
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    state = json.loads(spark.read.text(f"{path}/state", wholetext=True).first()["value"])
    return Bundle(features.Prep(**state.pop("prep")), **{n: GBTRegressionModel.load(f"{path}/{n}") for n in _MODELS}, **state)


def run_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(lookup.RUN_SCHEMA).parquet(f"{root}/runs")


def load_production(spark: SparkSession, root: str, run_name: str = "tabular") -> Bundle:
    """The bundle of the latest production run; an error when there is none."""
    run = lookup.production_run(run_rows(spark, root).filter(F.col("run_name") == run_name)).first()
    if run is None:
        raise LookupError(f"no production run named {run_name} under {root}")
    return load_bundle(spark, f"{root}/bundles/{run['run_id']}")


def save_split(split: DataFrame, path: str) -> str:
    """Store an assignment of rows to splits; an existing one is never replaced."""
    split.write.mode("error").parquet(path)
    return path


def load_split(spark: SparkSession, path: str) -> DataFrame:
    """A stored assignment; Spark's own error when there is none, never a new split."""
    return spark.read.schema("asset_id string, split string").parquet(path)
