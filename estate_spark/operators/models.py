"""Price models on Spark ML: boosted trees for the price and for its quantiles, a log-price
rival, a probe head, and the bundle that scores batches."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.operators import boost, evaluate, features, sampling
from estate_spark.session import grown, scratch_path, written

VECTOR = "features"


@dataclass
class Bundle:
    prep: features.Prep
    names: list[str]                 # vector slots, in order
    point: object
    low: object                      # trees of the lower quantile
    high: object
    quantiles: dict                  # base and rate of low and high, and steps where the trees don't hold them
    calibration_q: float = 0.0
    test_coverage: float = 0.0
    test_metrics: dict = field(default_factory=dict)
    rounds: dict = field(default_factory=dict)      # model -> best round, rounds run, held losses
    run_id: str = ""

    def info(self) -> dict:
        return {"model_type": "spark_gbt", "run_id": self.run_id, "interval_method": "cqr_boosted_quantiles",
                "interval_coverage": evaluate.NOMINAL_COVERAGE, "interval_test_coverage": self.test_coverage,
                "calibration_q": self.calibration_q, "test_metrics": self.test_metrics,
                "best_rounds": {k: v["best"] for k, v in self.rounds.items()}}


def vector_names(prep: features.Prep) -> list[str]:
    return [*prep.numeric, features.YEAR_MISSING, *prep.categorical]


def assemble(df: DataFrame, prep: features.Prep) -> DataFrame:
    """Imputed numeric columns, the year indicator and category indexes as one vector; the
    indexes carry their level count, so the trees treat them as categories. Originals stay."""
    raw = df.withColumn("_row", F.struct(*df.columns))
    x = features.impute(raw, prep)
    out = [f"_{c}" for c in prep.categorical]
    for c in prep.categorical:        # one model a column: label lists differ in length
        x = StringIndexerModel.from_labels(
            prep.levels[c], inputCol=c, outputCol=f"_{c}", handleInvalid="keep").transform(x)
    names = [*prep.numeric, features.YEAR_MISSING, *out]
    x = VectorAssembler(inputCols=names, outputCol=VECTOR).transform(x)
    return x.select("_row.*", VECTOR)


def _bins(prep: features.Prep) -> int:
    return max([32, *[len(v) + 2 for v in prep.levels.values()]])


def train_points(assembled: DataFrame, prep: features.Prep, alphas: list[float | None], **params) -> list[boost.Boosted]:
    """Boosted trees for the price (None) or its quantiles, fitted side by side on the rows of split
    ``train`` and stopped by those of ``val``."""
    rows = assembled.filter(F.col("split").isin("train", "val"))
    return boost.boost_all(rows, C.TARGET, VECTOR, F.col("split") == "val", alphas, max_bins=_bins(prep), **params)


def train_point(assembled: DataFrame, prep: features.Prep, alpha: float | None = None, **params) -> boost.Boosted:
    return train_points(assembled, prep, [alpha], **params)[0]


def predict_raw(assembled: DataFrame, bundle: Bundle) -> DataFrame:
    """estimate, q05, q95."""
    sides = {"q05": "low", "q95": "high"}
    # bundles stored earlier hold the steps beside the trees
    beside = {out: side for out, side in sides.items() if bundle.quantiles[side]["steps"] is not None}
    x = boost.predict(assembled, estimate=bundle.point, **{out: getattr(bundle, side) for out, side in sides.items() if out not in beside})
    for out, side in beside.items():
        q = bundle.quantiles[side]
        x = boost.predict_steps(x, getattr(bundle, side), q["base"], q["steps"], q["rate"], out)
    return x


def score(df: DataFrame, bundle: Bundle, keep: list[str] = ("asset_id",)) -> DataFrame:
    """keep..., estimate, low, high and the nominal and measured coverage, for any rows with
    the usable features. One narrow pass: no shuffle, no state."""
    raw = predict_raw(assemble(df, bundle.prep), bundle)
    band = evaluate.apply_band(raw, F.lit(bundle.calibration_q))
    # a sum carries no column metadata of the model, which files can't hold
    estimate = (F.col("estimate") + F.lit(0.0)).alias("estimate")
    return band.select(*keep, estimate, "low", "high",
                       F.lit(evaluate.NOMINAL_COVERAGE).alias("interval_coverage"),
                       F.lit(bundle.test_coverage).alias("interval_test_coverage"))


def train_bundle(listings: DataFrame, split: DataFrame, **params) -> Bundle:
    """Fit on train, stop on val, calibrate on val, measure on test."""
    rows = listings.join(grown(split), "asset_id")
    roles = C.feature_roles()
    C.assert_no_leakage(roles.usable)
    train = rows.filter("split = 'train'")
    prep = features.fit(train)
    x = assemble(rows, prep).select("asset_id", C.TARGET, "split", VECTOR).persist()
    try:
        point, low, high = train_points(x, prep, [None, evaluate.ALPHA_LOW, evaluate.ALPHA_HIGH], **params)
        parts = {"point": point, "low": low, "high": high}
        b = Bundle(prep, vector_names(prep), point.trees.setPredictionCol("estimate"), low.trees, high.trees,
                   {k: {"base": parts[k].base, "steps": None, "rate": parts[k].rate} for k in ("low", "high")},
                   rounds={k: {"best": v.best, "run": len(v.curve) - 1, "losses": v.curve} for k, v in parts.items()})
        raw = written(predict_raw(x.filter("split in ('val', 'test')"), b).drop(VECTOR), "raw-scores")
        b.calibration_q = float(evaluate.cqr_calibrate(
            raw.filter("split = 'val'"), C.TARGET, "q05", "q95").first()["calibration_q"])
        test = evaluate.apply_band(raw.filter("split = 'test'"), F.lit(b.calibration_q))
        b.test_coverage = float(evaluate.coverage(test, C.TARGET, "low", "high").first()["coverage"])
        b.test_metrics = evaluate.metrics(test, C.TARGET, "estimate").first().asDict()
    finally:
        x.unpersist()
    b.run_id = uuid.uuid5(uuid.NAMESPACE_OID, f"{b.calibration_q}{b.test_metrics}").hex
    return b


def importance(model, names: list[str]) -> DataFrame:
    """feature, gain, share of a tree model."""
    spark = SparkSession.active()
    gains = model.featureImportances.toArray()
    pairs = spark.createDataFrame([(n, float(g)) for n, g in zip(names, gains)], "feature string, gain double")
    return evaluate.importance_shares(pairs)


def train_alt(listings: DataFrame, split: DataFrame) -> DataFrame:
    """Second candidate: ridge regression of the standardized log price on standardized
    and one-hot features; returns asset_id, split, price, estimate of all rows."""
    rows = listings.join(grown(split), "asset_id")
    train = rows.filter("split = 'train'")
    categories = list(C.feature_roles().categorical)
    prep = features.fit(train, categorical=[])
    mean, std = features.log_target_stats(train)
    levels = features.fit_levels(train, categories)
    x = features.standardize(features.impute(features.one_hot(rows, levels, categories), prep), prep)
    cols = [*prep.numeric, features.YEAR_MISSING, *[f"{c}_onehot" for c in categories]]
    x = VectorAssembler(inputCols=cols, outputCol=VECTOR).transform(x).select(
        "asset_id", "split", C.TARGET, VECTOR, features.to_log_target(C.TARGET, mean, std).alias("z"))
    model = LinearRegression(featuresCol=VECTOR, labelCol="z", predictionCol="zhat", regParam=0.01,
                             solver="l-bfgs", standardization=False).fit(x.filter("split = 'train'"))
    return model.transform(x).select("asset_id", "split", C.TARGET,
                                     features.from_log_target("zhat", mean, std).alias("estimate"))


PROBE_C = 0.1                    # fixed value


def fit_probe(train: DataFrame, label: str, vector: str, iterations: int = 100):
    """Standardize, then a class-balanced logistic head; returns a scoring function."""
    scaler = StandardScaler(inputCol=vector, outputCol="_scaled", withMean=True, withStd=True).fit(train)
    n = train.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    pos, neg = max(n["p"], 1), max(n["n"] - n["p"], 1)
    weight = F.when(F.col(label) == 1, n["n"] / (2.0 * pos)).otherwise(n["n"] / (2.0 * neg))
    lr = LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="_w", maxIter=iterations,
                            regParam=1.0 / (PROBE_C * n["n"]), elasticNetParam=0.0, standardization=False,
                            probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    # a fitted model's summary holds the session, which tasks can't take once a frame was observed;
    # a loaded one has none
    path = scratch_path(train.sparkSession, "probe")
    lr.fit(scaler.transform(train).withColumn("_w", weight)).write().save(path)
    model = LogisticRegressionModel.load(path)

    def apply(df: DataFrame, keep: list[str]) -> DataFrame:
        return model.transform(scaler.transform(df)).select(
            *keep, vector_to_array(F.col("_prob"))[1].alias("score"))
    return apply


def probe_oof(df: DataFrame, key: str, label: str, vector: str, folds: int = sampling.N_FOLDS) -> DataFrame:
    """key, label, role, score: out-of-fold scores of the train rows, full-fit scores of the
    eval rows. ``df`` has key, label, role and an array column."""
    x = written(df.select(key, label, "role", array_to_vector(F.col(vector).cast("array<double>")).alias("_x"),
                          sampling.fold_of(key, folds).alias("_fold")), "probe")
    keep = [key, label, "role"]
    train = x.filter("role = 'train'")
    out = fit_probe(train, label, "_x")(x.filter("role = 'eval'"), keep)
    for k in range(folds):
        head = fit_probe(train.filter(F.col("_fold") != k), label, "_x")
        out = out.unionByName(head(train.filter(F.col("_fold") == k), keep))
    return out


def ablate(rows: DataFrame, score_col: str, **params) -> DataFrame:
    """Same rows and stop set, without and with one more feature; metric deltas. ``rows`` has
    the usable features, price, ``stage`` (fit, stop, eval) and the candidate score."""
    result = None
    fit_rows = rows.withColumn("split", F.expr("case stage when 'fit' then 'train' when 'stop' then 'val' else 'test' end"))
    roles = C.feature_roles()

    def fit(extra: list[str]):
        prep = features.fit(fit_rows.filter("split = 'train'"), numeric=[*roles.numeric, *extra])
        x = assemble(fit_rows, prep)
        return train_point(x, prep, **params), x

    for name, (model, x) in zip(("without", "with"), boost.together(lambda: fit([]), lambda: fit([score_col]))):
        m = evaluate.metrics(model.apply(x.filter("split = 'test'"), "estimate"), C.TARGET, "estimate").withColumn(
            "variant", F.lit(name))
        result = m if result is None else result.unionByName(m)
    return evaluate.metric_deltas(result, "variant", "without", "with")


def spark_mae(df: DataFrame) -> float:
    """Cross-check of our mae by Spark's own evaluator."""
    return RegressionEvaluator(labelCol=C.TARGET, predictionCol="estimate", metricName="mae").evaluate(df)
