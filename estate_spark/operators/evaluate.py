"""Metrics, interval calibration and ranking scores as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.operators import ranks

# fixed values
ALPHA_LOW, ALPHA_HIGH = 0.05, 0.95
NOMINAL_COVERAGE = 0.90


def metrics(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """mae, rmse, mape (percent)."""
    err = F.col(y) - F.col(yhat)
    return df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(err, F.col(y)))) * 100.0).alias("mape"), F.count("*").alias("n"))


def pinball(df: DataFrame, y: str, q: str, alpha: float, by: list[str] = ()) -> DataFrame:
    d = F.col(y) - F.col(q)
    return df.groupBy(*by).agg(F.avg(F.greatest(d * alpha, d * (alpha - 1.0))).alias("pinball"))


def conformity(y: str, low: str, high: str) -> Column:
    """How far the truth lies outside the raw band (negative inside)."""
    return F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high))


def cqr_calibrate(val: DataFrame, y: str, low: str, high: str, alpha_low: float = ALPHA_LOW,
                  alpha_high: float = ALPHA_HIGH, small: bool | None = None) -> DataFrame:
    """One row: n, k, calibration_q = the k-th smallest conformity score on the validation
    rows, k = min(ceil((n+1)(high-low)), n)."""
    scores = val.select(conformity(y, low, high).alias("score"))
    n = F.col("n")
    k = F.least(F.ceil((n + 1) * F.lit(alpha_high - alpha_low)), n)
    return ranks.kth_smallest(scores, "score", k, small).select("n", "k", F.col("kth").alias("calibration_q"))


def apply_band(df: DataFrame, q: Column, point: str = "estimate", low: str = "q05", high: str = "q95") -> DataFrame:
    """low, high and what had to be corrected: pad by q, order the ends, then include the
    point, in this order."""
    lo, hi = F.col(low) - q, F.col(high) + q
    out = df.withColumn("_lo", lo).withColumn("_hi", hi)
    out = (out.withColumn("crossing", F.col("_lo") > F.col("_hi"))
           .withColumn("low", F.least("_lo", "_hi")).withColumn("high", F.greatest("_lo", "_hi")))
    out = out.withColumn("point_excluded", (F.col(point) < F.col("low")) | (F.col(point) > F.col("high")))
    return (out.withColumn("corrected", F.col("crossing") | F.col("point_excluded"))
            .withColumn("low", F.least(F.col("low"), F.col(point)))
            .withColumn("high", F.greatest(F.col("high"), F.col(point))).drop("_lo", "_hi"))


def coverage(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    inside = F.col(y).between(F.col(low), F.col(high))
    return df.agg(F.avg(inside.cast("double")).alias("coverage"),
                  F.avg(F.col(high) - F.col(low)).alias("mean_width"), F.count("*").alias("n"))


def band_variants(test: DataFrame, y: str, q: Column, point: str = "estimate", low: str = "q05",
                  high: str = "q95") -> DataFrame:
    """variant, coverage, mean_width for the pure, the point-including and the calibrated
    band, in one pass."""
    pure_lo, pure_hi = F.least(low, high), F.greatest(low, high)
    raw_lo, raw_hi = F.least(pure_lo, F.col(point)), F.greatest(pure_hi, F.col(point))
    cal = apply_band(test, q, point, low, high).withColumns(
        {"pure_lo": pure_lo, "pure_hi": pure_hi, "raw_lo": raw_lo, "raw_hi": raw_hi})
    pairs = [("pure", "pure_lo", "pure_hi"), ("raw", "raw_lo", "raw_hi"), ("calibrated", "low", "high")]
    one = cal.agg(*[a for name, lo, hi in pairs for a in (
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias(f"c_{name}"),
        F.avg(F.col(hi) - F.col(lo)).alias(f"w_{name}"))])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(name).alias("variant"), F.col(f"c_{name}").alias("coverage"),
        F.col(f"w_{name}").alias("mean_width")) for name, _, _ in pairs])).alias("r")).select("r.*")


def band_counts(banded: DataFrame) -> DataFrame:
    return banded.agg(*[F.count_if(c).alias(f"n_{c}") for c in ("crossing", "point_excluded", "corrected")])


def residual_band(val: DataFrame, y: str, yhat: str, alpha_low: float = ALPHA_LOW,
                  alpha_high: float = ALPHA_HIGH, small: bool | None = None) -> DataFrame:
    """One row: the two residual quantiles of the older constant band."""
    res = val.select((F.col(y) - F.col(yhat)).alias("residual"))
    q = ranks.quantile_rows(res, ["residual"], [alpha_low, alpha_high], small=small)
    return q.select(F.col(ranks._label(alpha_low)).alias("residual_low"),
                    F.col(ranks._label(alpha_high)).alias("residual_high"))


def _score_counts(df: DataFrame, label: str, score: str, small: bool | None) -> DataFrame:
    """Per distinct score: positives and negatives here, below and in all."""
    small = ranks.is_small(df) if small is None else small
    rows = df.select(F.lit(score).alias("series"), F.col(score).cast("double").alias("value"),
                     (F.col(label) == 1).cast("bigint").alias("pos"), (F.col(label) != 1).cast("bigint").alias("neg"))
    return ranks.running_counts(rows, [], ["pos", "neg"], small)


def roc_auc(df: DataFrame, label: str, score: str, small: bool | None = None) -> DataFrame:
    """Exact and tie-aware: a positive beats the negatives below and half of its ties."""
    c = _score_counts(df, label, score, small)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return c.agg(F.try_divide(F.sum(wins), F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, small: bool | None = None) -> DataFrame:
    """Step-wise: recall gained at each distinct score times the precision at it."""
    c = _score_counts(df, label, score, small)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return c.agg(F.sum(F.try_divide("pos", "pos_total") * F.try_divide(tp, tp + fp)).alias("average_precision"))


def balanced_accuracy(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    hit = (F.col(score) >= cut).cast("double")
    return df.agg(((F.avg(F.when(F.col(label) == 1, hit)) + F.avg(F.when(F.col(label) != 1, 1.0 - hit))) / 2.0)
                  .alias("balanced_accuracy"))


def metric_deltas(metrics_by: DataFrame, by: str, base: str, other: str) -> DataFrame:
    """metric, base, other, delta, delta_pct from one row per variant."""
    cols = ["mae", "rmse", "mape"]
    one = metrics_by.agg(*[F.max(F.when(F.col(by) == v, F.col(c))).alias(f"{v}_{c}")
                           for v in (base, other) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("metric"), F.col(f"{base}_{c}").alias("base"), F.col(f"{other}_{c}").alias("other"))
        for c in cols])).alias("r")).select("r.*").withColumn(
            "delta", F.col("other") - F.col("base")).withColumn(
            "delta_pct", F.try_divide(F.col("delta"), F.col("base")) * 100.0)


def compare_models(metrics_by: DataFrame, baseline: str) -> DataFrame:
    """Metrics per model with ``winner``: lowest mae, the baseline on a tie."""
    best = metrics_by.agg(F.min_by("model", F.struct("mae", F.col("model") != baseline, "model"))).scalar()
    return metrics_by.withColumn("winner", F.col("model") == best)


def comparison_lines(compared: DataFrame) -> DataFrame:
    """line_no, line: the model table as Markdown."""
    body = compared.select(
        (F.row_number().over(_by_name()) + 2).alias("line_no"), F.concat(
            F.lit("| "), F.col("model"), F.lit(" | "), F.format_number("mae", 0), F.lit(" | "),
            F.format_number("rmse", 0), F.lit(" | "), F.call_function("format_number", F.col("mape"), F.lit("0.00")),
            F.lit(" |")).alias("line"))
    win = compared.filter("winner").select(F.lit(1000).alias("line_no"), F.concat(
        F.lit("Winner (lowest test MAE): "), F.col("model"), F.lit(". Saved as the production artifact.")).alias("line"))
    spark = compared.sparkSession
    head = spark.createDataFrame([(1, "| Model | MAE (EUR) | RMSE (EUR) | MAPE (%) |"), (2, "|---|---|---|---|")],
                                 "line_no int, line string")
    return head.unionByName(body).unionByName(win)


def _by_name():
    from pyspark.sql.window import Window
    return Window.orderBy("model")      # one row per compared model


def importance_shares(pairs: DataFrame, warn_above: float = 0.9) -> DataFrame:
    """feature, gain, share (of a feature, gain table), flagged when one feature dominates."""
    total = pairs.agg(F.sum("gain")).scalar()
    return (pairs.withColumn("share", F.when(total > 0, F.col("gain") / F.nullif(total, F.lit(0.0))).otherwise(0.0))
            .withColumn("suspicious", F.col("share") > warn_above))
