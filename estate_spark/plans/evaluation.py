"""Evaluation and drift as named queries, on fixed predictions and hash samples."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.operators import curate, drift, evaluate, ranks, sampling
from estate_spark.plans.base_sql import hash_sql, on_listings, on_split
from estate_spark.plans.registry import query
from estate_spark.plans.sampling import split
from estate_spark.session import once, scratch_path, written
from estate_spark.sources import io

# deterministic predictions: a price per m2, bands as multiples of it
PRED = ("pred", """SELECT l.asset_id, split, price, area_m2, property_type, 2500::DOUBLE * area_m2 AS estimate, 0.6::DOUBLE * (2500::DOUBLE * area_m2) AS q05,
    1.5::DOUBLE * (2500::DOUBLE * area_m2) AS q95 FROM listings l JOIN split s ON s.asset_id = l.asset_id""")
CQR = ("cqr", """SELECT n, k, (SELECT score FROM (SELECT greatest(q05 - price, price - q95) AS score, row_number() OVER (ORDER BY greatest(q05 - price, price - q95)) AS r
      FROM pred WHERE split = 'val') s WHERE r = k) AS calibration_q
    FROM (SELECT n, least(CAST(ceil((n + 1) * (0.95::DOUBLE - 0.05::DOUBLE)) AS BIGINT), n) AS k FROM (SELECT count(*) AS n FROM pred WHERE split = 'val') q1) q2""")
BANDED = ("banded", """SELECT *, least(lo0, estimate) AS low, greatest(hi0, estimate) AS high, estimate < lo0 OR estimate > hi0 AS point_excluded FROM (
    SELECT *, least(q05 - calibration_q, q95 + calibration_q) AS lo0, greatest(q05 - calibration_q, q95 + calibration_q) AS hi0,
      q05 - calibration_q > q95 + calibration_q AS crossing FROM pred, cqr) q""")


def predictions(spark, sf):
    df = curate.curated(spark, sf).select("asset_id", "price", "area_m2", "property_type").join(split(spark, sf), "asset_id")
    point = F.lit(2500.0) * F.col("area_m2")
    return (df.withColumn("estimate", point).withColumn("q05", F.lit(0.6) * F.col("estimate"))
            .withColumn("q95", F.lit(1.5) * F.col("estimate")))


def calibration(spark, sf):
    return evaluate.cqr_calibrate(predictions(spark, sf).filter("split = 'val'"), "price", "q05", "q95")


def q_value(spark, sf):
    return calibration(spark, sf).select("calibration_q").scalar()


_MET = """round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse,
    round(avg(abs(({y} - {p}) / {y})) * 100, 6) AS mape"""


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("regression_metrics", on_split(f"SELECT split, {_MET.format(y='price', p='estimate')}, count(*) AS n FROM pred GROUP BY 1", PRED))
def regression_metrics(spark, sf):
    return _rounded(evaluate.metrics(predictions(spark, sf), "price", "estimate", ["split"]), ["mae", "rmse", "mape"])


@query("pinball_loss", on_split("""SELECT split, round(avg(greatest(0.05::DOUBLE * (price - q05), (0.05::DOUBLE - 1) * (price - q05))), 6) AS low_loss,
    round(avg(greatest(0.95::DOUBLE * (price - q95), (0.95::DOUBLE - 1) * (price - q95))), 6) AS high_loss FROM pred GROUP BY 1""", PRED))
def pinball_loss(spark, sf):
    p = predictions(spark, sf)
    low = evaluate.pinball(p, "price", "q05", 0.05, ["split"]).withColumnRenamed("pinball", "low_loss")
    high = evaluate.pinball(p, "price", "q95", 0.95, ["split"]).withColumnRenamed("pinball", "high_loss")
    return _rounded(low.join(high, "split"), ["low_loss", "high_loss"])


@query("cqr_calibrate", on_split("SELECT n, k, calibration_q FROM cqr", PRED, CQR))
def cqr_calibrate(spark, sf):
    return calibration(spark, sf)


@query("rank_kth", on_listings("""SELECT n, k, price AS kth FROM (SELECT price, row_number() OVER (ORDER BY price) AS r, count(*) OVER () AS n FROM listings) q,
    LATERAL (SELECT CAST(ceil(n * CAST(0.9 AS DOUBLE)) AS BIGINT) AS k) kk WHERE r = k"""))
def rank_kth(spark, sf):
    return ranks.kth_smallest(curate.curated(spark, sf), "price", ranks.ceil_share(F.col("n"), 0.9))


@query("band_apply", on_split("SELECT asset_id, estimate, low, high, crossing, point_excluded FROM banded WHERE split = 'test'", PRED, CQR, BANDED))
def band_apply(spark, sf):
    t = predictions(spark, sf).filter("split = 'test'")
    return evaluate.apply_band(t, q_value(spark, sf)).select("asset_id", "estimate", "low", "high", "crossing", "point_excluded")


@query("coverage_width", on_split("""SELECT 'pure' AS variant, round(avg(CASE WHEN price BETWEEN least(q05, q95) AND greatest(q05, q95) THEN 1.0 ELSE 0.0 END), 6) AS coverage,
      round(avg(greatest(q05, q95) - least(q05, q95)), 6) AS mean_width FROM banded WHERE split = 'test'
    UNION ALL SELECT 'raw', round(avg(CASE WHEN price BETWEEN least(q05, q95, estimate) AND greatest(q05, q95, estimate) THEN 1.0 ELSE 0.0 END), 6),
      round(avg(greatest(q05, q95, estimate) - least(q05, q95, estimate)), 6) FROM banded WHERE split = 'test'
    UNION ALL SELECT 'calibrated', round(avg(CASE WHEN price BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6), round(avg(high - low), 6)
      FROM banded WHERE split = 'test'""", PRED, CQR, BANDED))
def coverage_width(spark, sf):
    v = evaluate.band_variants(predictions(spark, sf).filter("split = 'test'"), "price", q_value(spark, sf))
    return _rounded(v, ["coverage", "mean_width"])


@query("residual_band", on_split("""SELECT round(quantile_cont(price - estimate, 0.05), 6) AS residual_low, round(quantile_cont(price - estimate, 0.95), 6) AS residual_high
    FROM pred WHERE split = 'val'""", PRED))
def residual_band(spark, sf):
    r = evaluate.residual_band(predictions(spark, sf).filter("split = 'val'"), "price", "estimate")
    return _rounded(r, ["residual_low", "residual_high"])


# a score per vector (its first component squashed by rounding, so ties occur) against label % 2
_SCORED = "SELECT vec_id, label % 2 AS y, CAST(floor(embedding[{i}] * 50) AS DOUBLE) / CAST(50 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS score FROM embeddings"
SCORED = "WITH scored AS (" + _SCORED.format(i=1) + ")"
COUNTS = """, c AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY 1),
    r AS (SELECT *, sum(pos) OVER w - pos AS pos_before, sum(neg) OVER w - neg AS neg_before, sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM c WINDOW w AS (ORDER BY score)) """


def scored_vectors(spark, sf):
    e = io.read_table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") % 2).alias("y"), (
        F.floor(F.col("embedding")[0].cast("float") * 50).cast("double") / 50.0 + 0.5).alias("score"))


@query("auc", SCORED + COUNTS + "SELECT round(sum(pos * (neg_before + neg / CAST(2 AS DOUBLE))) / (CAST(max(p) AS DOUBLE) * max(n)), 6) AS auc FROM r")
def auc(spark, sf):
    return _rounded(evaluate.roc_auc(scored_vectors(spark, sf), "y", "score"), ["auc"])


@query("average_precision", SCORED + COUNTS + """SELECT round(sum(pos / CAST(p AS DOUBLE) * ((p - pos_before) / CAST(p - pos_before + n - neg_before AS DOUBLE))), 6)
    AS average_precision FROM r""")
def average_precision(spark, sf):
    return _rounded(evaluate.average_precision(scored_vectors(spark, sf), "y", "score"), ["average_precision"])


@query("balanced_accuracy", SCORED + """SELECT round((avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE y = 1)
    + avg(CASE WHEN score >= 0.5 THEN 0.0 ELSE 1.0 END) FILTER (WHERE y = 0)) / 2, 6) AS balanced_accuracy FROM scored""")
def balanced_accuracy(spark, sf):
    return _rounded(evaluate.balanced_accuracy(scored_vectors(spark, sf), "y", "score"), ["balanced_accuracy"])


TWO = ("two", """SELECT 'baseline' AS model, price, estimate AS yhat FROM pred WHERE split = 'test'
    UNION ALL SELECT 'alternative', price, 2300::DOUBLE * area_m2 + 20000 FROM pred WHERE split = 'test'""")
TWO_M = ("two_m", f"SELECT model, avg(abs(price - yhat)) AS raw_mae, {_MET.format(y='price', p='yhat')}, count(*) AS n FROM two GROUP BY 1")


def two_models(spark, sf):
    t = predictions(spark, sf).filter("split = 'test'")
    both = t.select(F.lit("baseline").alias("model"), "price", F.col("estimate").alias("yhat")).unionByName(
        t.select(F.lit("alternative").alias("model"), "price", (F.lit(2300.0) * F.col("area_m2") + 20000).alias("yhat")))
    return evaluate.metrics(both, "price", "yhat", ["model"])


@query("metric_deltas", on_split(" UNION ALL ".join(
    f"SELECT '{m}' AS metric, b.{m} AS base, o.{m} AS other, round(o.{m} - b.{m}, 4) AS delta, round((o.{m} - b.{m}) / b.{m} * 100, 4) AS delta_pct FROM two_m b, two_m o WHERE b.model = 'baseline' AND o.model = 'alternative'"
    for m in ("mae", "rmse", "mape")), PRED, TWO, TWO_M))
def metric_deltas(spark, sf):
    d = evaluate.metric_deltas(two_models(spark, sf), "model", "baseline", "alternative")
    return d.select("metric", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"),
                    F.round("delta", 4).alias("delta"), F.round("delta_pct", 4).alias("delta_pct"))


@query("compare_models", on_split("""SELECT model, mae, rmse, mape, n, model = (SELECT model FROM two_m ORDER BY raw_mae, model <> 'baseline', model LIMIT 1) AS winner
    FROM two_m""", PRED, TWO, TWO_M))
def compare_models(spark, sf):
    return _rounded(evaluate.compare_models(two_models(spark, sf), "baseline"), ["mae", "rmse", "mape"])


@query("comparison_report", on_split("""SELECT 1 AS line_no, '| Model | MAE (EUR) | RMSE (EUR) | MAPE (%) |' AS line
    UNION ALL SELECT 2, '|---|---|---|---|'
    UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY model) AS INTEGER), concat('| ', model, ' | ', format('{:,.0f}', mae), ' | ', format('{:,.0f}', rmse), ' | ', format('{:.2f}', mape), ' |') FROM two_m
    UNION ALL SELECT 1000, concat('Winner (lowest test MAE): ', (SELECT model FROM two_m ORDER BY raw_mae, model <> 'baseline', model LIMIT 1), '. Saved as the production artifact.')""",
    PRED, TWO, TWO_M))
def comparison_report(spark, sf):
    return evaluate.comparison_lines(evaluate.compare_models(two_models(spark, sf), "baseline"))


# ---------------------------------------------------------------- drift
COLS = C.numeric_candidates()[:-1]
assert "cnn_condition_score" not in COLS
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {{0}} WHERE {c} IS NOT NULL" for c in COLS)
_H = hash_sql("l.asset_id", 42)
DRIFT = [("ref", "SELECT l.* FROM listings l JOIN split s ON s.asset_id = l.asset_id WHERE split = 'train'"),
         ("cur", f"SELECT l.* REPLACE (l.area_m2 * 3::DOUBLE AS area_m2) FROM ref l WHERE {hash_sql('l.asset_id', 7)} < {int(0.25 * 2**32)}"),
         ("ref_long", _LONG.format("ref")), ("cur_long", _LONG.format("cur"))]
PSI = [("edges", """SELECT feature, list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM ref_long GROUP BY 1"""),
       ("inner_edges", "SELECT feature, i - 2 AS i, e[i] AS edge FROM (SELECT feature, e, unnest(range(2, len(e))) AS i FROM edges) q"),
       ("grid", "SELECT feature, unnest(range(0, greatest(len(e) - 1, 1))) AS bin FROM edges"),
       *[(f"{s}_bins", f"""SELECT feature, bin, count(*) AS n FROM (SELECT l.feature, l.v,
            (SELECT count(*) FROM inner_edges x WHERE x.feature = l.feature AND x.edge <= l.v) AS bin FROM {s}_long l) q GROUP BY 1, 2""")
         for s in ("ref", "cur")],
       ("psi_bins", """SELECT g.feature, g.bin, coalesce(r.n, 0) AS n_ref, coalesce(c.n, 0) AS n_cur FROM grid g
          LEFT JOIN ref_bins r ON r.feature = g.feature AND r.bin = g.bin LEFT JOIN cur_bins c ON c.feature = g.feature AND c.bin = g.bin"""),
       ("psi", """SELECT feature, CASE WHEN (SELECT len(e) FROM edges x WHERE x.feature = q.feature) < 2 THEN 0.0::DOUBLE ELSE sum((fc - fr) * ln(fc / fr)) END AS psi FROM (
          SELECT feature, greatest(n_ref / CAST(sum(n_ref) OVER w AS DOUBLE), 1e-6::DOUBLE) AS fr, greatest(n_cur / CAST(sum(n_cur) OVER w AS DOUBLE), 1e-6::DOUBLE) AS fc
          FROM psi_bins WINDOW w AS (PARTITION BY feature)) q GROUP BY 1""")]
KS = [("vc", """SELECT feature, v, count(*) FILTER (WHERE s = 1) AS r, count(*) FILTER (WHERE s = 0) AS c FROM (
          SELECT feature, v, 1 AS s FROM ref_long UNION ALL SELECT feature, v, 0 FROM cur_long) q GROUP BY 1, 2"""),
      ("ecdf", """SELECT feature, v, sum(r) OVER w / CAST(sum(r) OVER a AS DOUBLE) AS fr, sum(c) OVER w / CAST(sum(c) OVER a AS DOUBLE) AS fc,
          sum(r) OVER a AS n1, sum(c) OVER a AS n2 FROM vc WINDOW w AS (PARTITION BY feature ORDER BY v), a AS (PARTITION BY feature)"""),
      ("ks_d", "SELECT feature, max(abs(fr - fc)) AS d, max(n1) AS n1, max(n2) AS n2 FROM ecdf GROUP BY 1"),
      ("ks", """SELECT feature, d, CASE WHEN t2 < 0.04 THEN 1.0::DOUBLE ELSE least(greatest((SELECT sum((CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * j * j * t2))
          FROM (SELECT unnest(range(1, 101)) AS j) jj), 0), 1) END AS p FROM (SELECT *, d * d * (CAST(n1 AS DOUBLE) * n2) / (n1 + n2) AS t2 FROM ks_d) q""")]
TABLE = ("drift_rows", """SELECT psi.feature, round(psi, 6) AS psi, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value, psi > 0.2 AS drifted, psi AS psi_raw, d AS d_raw, p AS p_raw
    FROM psi JOIN ks ON ks.feature = psi.feature""")


def reference_frame(spark, sf):
    return once(spark, ("drift-ref", sf), lambda: written(
        curate.curated(spark, sf).join(split(spark, sf).filter("split = 'train'"), "asset_id", "left_semi"), "drift-ref"))


def current_frame(spark, sf, factor=3.0):
    s = sampling.hash_sample(reference_frame(spark, sf), "asset_id", 0.25, 7)
    return s.withColumn("area_m2", F.col("area_m2") * F.lit(float(factor)))


@query("psi", on_split("SELECT feature, round(psi, 6) AS psi FROM psi", *DRIFT, *PSI))
def psi(spark, sf):
    return _rounded(drift.psi(reference_frame(spark, sf), current_frame(spark, sf), COLS), ["psi"])


@query("psi_term", on_split("""SELECT feature, bin, round((greatest(n_cur / c, 1e-6::DOUBLE) - greatest(n_ref / r, 1e-6::DOUBLE))
      * ln(greatest(n_cur / c, 1e-6::DOUBLE) / greatest(n_ref / r, 1e-6::DOUBLE)), 6) AS term
    FROM (SELECT *, CAST(sum(n_ref) OVER w AS DOUBLE) AS r, CAST(sum(n_cur) OVER w AS DOUBLE) AS c FROM psi_bins WINDOW w AS (PARTITION BY feature)) q""", *DRIFT, *PSI))
def psi_term(spark, sf):
    b = drift.psi_bins(drift.ranked(drift.state(reference_frame(spark, sf), current_frame(spark, sf), COLS)))
    t = b.groupBy("series").agg(F.sum("n_ref").alias("r"), F.sum("n_cur").alias("c"))
    return b.join(t, "series").select(F.col("series").alias("feature"), F.col("bin").cast("bigint").alias("bin"), F.round(
        drift.psi_term(F.col("n_ref").cast("double") / F.col("r"), F.col("n_cur").cast("double") / F.col("c")), 6).alias("term"))


@query("ecdf", on_split("SELECT feature, v AS value, fr AS cdf_ref, fc AS cdf_cur FROM ecdf", *DRIFT, *KS))
def ecdf(spark, sf):
    e = drift.ecdf(reference_frame(spark, sf), current_frame(spark, sf), COLS)
    return e.select(F.col("series").alias("feature"), "value", "cdf_ref", "cdf_cur")


@query("ks_2samp", on_split("SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value FROM ks", *DRIFT, *KS))
def ks_2samp(spark, sf):
    return _rounded(drift.ks(reference_frame(spark, sf), current_frame(spark, sf), COLS), ["ks_statistic", "ks_p_value"])


_DRIFT_COLS = "feature, psi, ks_statistic, ks_p_value, drifted"


@query("drift_table", on_split(f"SELECT {_DRIFT_COLS} FROM drift_rows", *DRIFT, *PSI, *KS, TABLE))
def drift_table(spark, sf):
    return _rounded(drift.drift_table(reference_frame(spark, sf), current_frame(spark, sf)), ["psi", "ks_statistic", "ks_p_value"])


@query("drift_summary", on_split(f"""SELECT (SELECT count(*) FROM ref) AS n_reference, (SELECT count(*) FROM cur) AS n_current, 0.2::DOUBLE AS psi_threshold,
    coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE drifted), '') AS drifted_features, bool_or(drifted) AS any_drift, '{drift.NOTE}' AS note FROM drift_rows""",
    *DRIFT, *PSI, *KS, TABLE))
def drift_summary(spark, sf):
    ref, cur = reference_frame(spark, sf), current_frame(spark, sf)
    return drift.drift_summary(drift.drift_table(ref, cur), ref, cur).withColumn("drifted_features", F.array_join("drifted_features", ","))


def _scenario(ctes: list[tuple[str, str]], suffix: str) -> list[tuple[str, str]]:
    """The same chain of views under other names, the reference side shared."""
    own = [n for n, _ in ctes if not n.startswith("ref") and n not in ("edges", "inner_edges", "grid")]
    names = "|".join(own)
    return [(f"{n}{suffix}", re.sub(rf"\b(FROM|JOIN) ({names})\b(?! [a-z])", rf"\1 \2{suffix} AS \2",
                                    re.sub(rf"\b(FROM|JOIN) ({names})\b(?= [a-z])", rf"\1 \2{suffix}", q))) for n, q in ctes if n in own]


SAME = _scenario([("cur", f"SELECT l.* FROM ref l WHERE {hash_sql('l.asset_id', 7)} < {int(0.25 * 2**32)}"), *DRIFT[2:], *PSI, *KS, TABLE], "_same")
_SUMMARY = "SELECT '{0}' AS scenario, count(*) FILTER (WHERE drifted) AS n_drifted, bool_or(drifted AND feature = 'area_m2') AS area_flagged FROM {1}"


@query("self_drift", on_split(_SUMMARY.format("area_x3", "drift_rows") + " UNION ALL " + _SUMMARY.format("clean_sample", "drift_rows_same"),
                              *DRIFT, *PSI, *KS, TABLE, *SAME))
def self_drift(spark, sf):
    """A clean sample of the reference must not drift; three times the area must."""
    ref = reference_frame(spark, sf)
    rows = [drift.drift_table(ref, current_frame(spark, sf, factor)).withColumn("scenario", F.lit(name))
            for name, factor in (("area_x3", 3.0), ("clean_sample", 1.0))]
    return rows[0].unionByName(rows[1]).groupBy("scenario").agg(
        F.count_if("drifted").alias("n_drifted"), F.bool_or(F.col("drifted") & (F.col("feature") == "area_m2")).alias("area_flagged"))


_POS = " ".join(f"WHEN '{c}' THEN {9 + i}" for i, c in enumerate(C.numeric_candidates()))
_HEAD = ["# Input-drift report", "", drift.NOTE, "", None, "PSI flag threshold: 0.2", "",
         "| feature | psi | ks_statistic | ks_p_value | drifted |", "|---|---|---|---|---|"]


@query("sink_report", on_split(" UNION ALL ".join(
    [f"SELECT {i} AS line_no, '{t}' AS line" for i, t in enumerate(_HEAD) if t is not None]
    + ["SELECT 4, concat('Reference rows: ', (SELECT count(*) FROM ref), '  Current rows: ', (SELECT count(*) FROM cur))",
       f"""SELECT CASE feature {_POS} END, concat('| ', feature, ' | ', format('{{:.4f}}', psi_raw), ' | ', format('{{:.4f}}', d_raw), ' | ', format('{{:.4g}}', p_raw), ' | ',
       CASE WHEN drifted THEN 'True' ELSE 'False' END, ' |') FROM drift_rows""", "SELECT 1000, ''",
       """SELECT 1001, CASE WHEN bool_or(drifted) THEN concat('Drifted features: ', string_agg(feature, ', ' ORDER BY feature) FILTER (WHERE drifted))
       ELSE 'No feature crossed the PSI threshold.' END FROM drift_rows"""]), *DRIFT, *PSI, *KS, TABLE))
def sink_report(spark, sf):
    ref, cur = reference_frame(spark, sf), current_frame(spark, sf)
    table = written(drift.drift_table(ref, cur), "drift-table")
    summary = drift.drift_summary(table, ref, cur)
    lines = drift.report_lines(table, summary)
    path = scratch_path(spark, "drift-report")
    lines.write.parquet(f"{path}/lines")
    drift.report_json(table, summary).write.text(f"{path}/json")
    return spark.read.parquet(f"{path}/lines")
