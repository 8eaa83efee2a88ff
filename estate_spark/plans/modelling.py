"""Feature preparation, models and attribution as named queries.

Fitted models have no SQL counterpart, so those queries are checked by their invariants in
the tests; everything that is arithmetic on rows or on a linear model has check SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.operators import boost, curate, evaluate, explain, features, models, ranks, sampling
from estate_spark.functions import labels, text
from estate_spark.plans.base_sql import on_listings, on_split
from estate_spark.plans.registry import query
from estate_spark.plans.sampling import TILED, PURITY, ASSIGNED, assigned, split, tile_scores, manifest
from estate_spark.session import grown, once, written
from estate_spark.sources import io

NUM = ["area_m2", "rooms", "bathrooms", "floor", "construction_year", "distance_to_metro", "cadastral_quality_id"]
CAT = ["property_type", "condition", "neighborhood_id"]
TRAIN = ("train", "SELECT l.* FROM listings l JOIN split s ON s.asset_id = l.asset_id WHERE split = 'train'")


def train_rows(spark, sf):
    return curate.curated(spark, sf).join(grown(split(spark, sf).filter("split = 'train'")), "asset_id", "left_semi")


def small_prep(spark, sf):
    return once(spark, ("prep", sf), lambda: features.fit(train_rows(spark, sf), NUM, CAT))


def level_table(spark, sf):
    return once(spark, ("levels", sf), lambda: features.fit_levels(train_rows(spark, sf), CAT))


@query("category_levels", on_split(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, string_agg(v, ',' ORDER BY v) AS levels FROM (SELECT DISTINCT {c} AS v FROM train WHERE {c} IS NOT NULL) q_{c}"
    for c in CAT), TRAIN))
def category_levels(spark, sf):
    rows = level_table(spark, sf).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("idx", "level"))).alias("r"))
    return rows.select("column_name", F.array_join("r.level", ",").alias("levels"))


@query("category_encode", on_split("SELECT asset_id, " + ", ".join(
    f"(SELECT count(DISTINCT t.{c}) FROM train t WHERE t.{c} < l.{c}) + CASE WHEN l.{c} IN (SELECT {c} FROM train) THEN 0 ELSE NULL END AS {c}_index"
    for c in CAT) + " FROM listings l", TRAIN))
def category_encode(spark, sf):
    e = features.encode(curate.curated(spark, sf), level_table(spark, sf), CAT)
    return e.select("asset_id", *[f"{c}_index" for c in CAT])


_MED = ("meds", "SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{c}" for c in NUM) + " FROM train")
_IMPUTED = ("imputed", "SELECT asset_id, CASE WHEN construction_year IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS year_missing, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS {c}" for c in NUM) + " FROM listings, meds")


@query("impute_median", on_split("SELECT * FROM imputed", TRAIN, _MED, _IMPUTED))
def impute_median(spark, sf):
    return features.impute(curate.curated(spark, sf), small_prep(spark, sf)).select("asset_id", "year_missing", *NUM)


@query("standardize", on_split("SELECT asset_id, " + ", ".join(
    f"round((i.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in NUM)
    + " FROM imputed i, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUM)
    + " FROM imputed WHERE asset_id IN (SELECT asset_id FROM train)) m", TRAIN, _MED, _IMPUTED))
def standardize(spark, sf):
    p = small_prep(spark, sf)
    x = features.standardize(features.impute(curate.curated(spark, sf), p), p)
    return x.select("asset_id", *[F.round(c, 6).alias(c) for c in NUM])


@query("onehot_unknown", on_split(" UNION ALL ".join(
    f"SELECT asset_id, CASE WHEN {c} IN (SELECT {c} FROM train) THEN concat('{c}__', {c}) ELSE '{c}__unknown' END AS slot FROM listings"
    for c in CAT), TRAIN))
def onehot_unknown(spark, sf):
    """The slots set to 1, by name: which slots exist depends on the train levels."""
    levels = level_table(spark, sf)
    x = features.encode(curate.curated(spark, sf), levels, CAT)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_index").alias("idx")) for c in CAT])).alias("r")
    rows = x.select("asset_id", cells).select("asset_id", "r.*").join(ranks.few(levels), ["column_name", "idx"], "left")
    return rows.select("asset_id", F.concat("column_name", F.lit("__"), F.coalesce("level", F.lit("unknown"))).alias("slot"))


_LOG = "(SELECT avg(ln(price)) AS m, stddev_pop(ln(price)) AS s FROM train) st"


@query("log_target", on_split(f"SELECT asset_id, round((ln(price) - m) / s, 6) AS z, round(exp(((ln(price) - m) / s) * s + m), 4) AS back FROM listings, {_LOG}", TRAIN))
def log_target(spark, sf):
    mean, std = features.log_target_stats(train_rows(spark, sf))
    z = curate.curated(spark, sf).select("asset_id", features.to_log_target("price", mean, std).alias("z"))
    return z.select("asset_id", F.round("z", 6).alias("z"), F.round(features.from_log_target("z", mean, std), 4).alias("back"))


# ---------------------------------------------------------------- fitted models
def bundle(spark, sf):
    return once(spark, ("bundle", sf), lambda: models.train_bundle(curate.curated(spark, sf), split(spark, sf)))


@query("train_point")
def train_point(spark, sf):
    b = bundle(spark, sf)
    x = models.assemble(curate.curated(spark, sf).join(grown(split(spark, sf)), "asset_id"), b.prep)
    return evaluate.metrics(boost.predict(x, estimate=b.point), "price", "estimate", ["split"]).withColumn("best_round", F.lit(b.rounds["point"]["best"]))


@query("train_quantile")
def train_quantile(spark, sf):
    b = bundle(spark, sf)
    x = models.assemble(curate.curated(spark, sf).join(grown(split(spark, sf)), "asset_id"), b.prep)
    return evaluate.band_variants(models.predict_raw(x, b).filter("split = 'test'"), "price", F.lit(b.calibration_q))


@query("train_alt")
def train_alt(spark, sf):
    return evaluate.metrics(models.train_alt(curate.curated(spark, sf), split(spark, sf)), "price", "estimate", ["split"])


@query("score_batch")
def score_batch(spark, sf):
    return models.score(curate.curated(spark, sf), bundle(spark, sf))


@query("importance_shares")
def importance_shares(spark, sf):
    b = bundle(spark, sf)
    return models.importance(b.point, b.names)


@query("ablation")
def ablation(spark, sf):
    """With and without a tile score, on the sampled tiles' rows."""
    tagged = assigned(spark, sf).select("asset_id", "tile_id", "split").join(
        manifest(spark, sf).select("tile_id", "role"), "tile_id").join(tile_scores(spark, sf), "tile_id")
    stage = F.when(F.col("split") == "val", "eval").when(sampling.held_out("tile_id"), "stop").otherwise("fit")
    rows = curate.curated(spark, sf).drop("cnn_condition_score").join(
        tagged.filter("(split = 'train' and role = 'train') or (split = 'val' and role = 'eval')").withColumn(
            "stage", stage).drop("split", "role", "tile_id"), "asset_id")
    return models.ablate(written(rows, "ablation"), "cnn_condition_score")


@query("probe_oof")
def probe_oof(spark, sf):
    rows = io.read_table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_id"), (F.col("label") % 2).alias("tile_label"),
        F.when(F.col("vec_id") % 5 == 0, "eval").otherwise("train").alias("role"), "embedding")
    return models.probe_oof(rows, "row_id", "tile_label", "embedding")


@query("shap_rows")
def shap_rows(spark, sf):
    return explain.shap_rows(curate.curated(spark, sf), bundle(spark, sf))


@query("shap_cache")
def shap_cache(spark, sf):
    """Rows of two splits cached, all rows asked for: the third split is computed."""
    b = bundle(spark, sf)
    rows = curate.curated(spark, sf)
    cached = rows.join(grown(split(spark, sf).filter("split <> 'test'")), "asset_id", "left_semi")
    cache = written(explain.shap_rows(cached, b).withColumn("run_id", F.lit(b.run_id)), "shap-cache")
    return explain.cache_or_compute(rows, cache, lambda d: explain.shap_rows(d, b), b.run_id).select(
        "asset_id", "prediction", "from_cache")


# ---------------------------------------------------------------- linear attribution
COEFS = {"area_m2": 2500.0, "rooms": 8000.0, "bathrooms": 12000.0, "floor": 1500.0, "construction_year": 300.0,
         "has_lift": 15000.0, "has_parking": 9000.0, "distance_to_metro": -7000.0, "distance_to_city_center": -2500.0}
INTERCEPT = 250000.0
_F = list(COEFS)
LINEAR = [("lin_means", "SELECT " + ", ".join(f"round(avg({f}), 6) AS m_{f}" for f in _F) + " FROM train"),
          ("lin", "SELECT l.asset_id, l.neighborhood_name, " + ", ".join(
              f"coalesce({COEFS[f]}::DOUBLE * (l.{f} - m_{f}), 0.0::DOUBLE) AS shap__{f}, l.{f}" for f in _F) + " FROM listings l, lin_means"),
          ("linear", f"SELECT *, {INTERCEPT}::DOUBLE AS base_value, {INTERCEPT}::DOUBLE + " + " + ".join(f"shap__{f}" for f in _F) + " AS prediction FROM lin")]


def linear_means(spark, sf):
    def build():
        row = train_rows(spark, sf).agg(*[F.round(F.avg(f), 6).alias(f) for f in _F]).first()
        return row.asDict()
    return once(spark, ("linear-means", sf), build)


def linear_shap(spark, sf, rows=None):
    rows = curate.curated(spark, sf) if rows is None else rows
    return explain.linear_rows(rows, COEFS, linear_means(spark, sf), INTERCEPT)


def _label_sql(f: str) -> str:
    if f in labels.BOOLEAN:
        a, b = labels.BOOLEAN[f]
        return f"CASE WHEN {f} = 1 THEN '{a}' ELSE '{b}' END"
    stem, digits, grouped, unit = labels.CONTINUOUS[f]
    return (f"CASE WHEN {f} IS NULL THEN '{stem}' ELSE concat('{stem} (', format('{{:{',' if grouped else ''}.{digits}f}}', CAST({f} AS DOUBLE)), '{unit})') END")


DRIVERS = [("driver_rows", " UNION ALL ".join(
    f"SELECT asset_id, prediction, '{f}' AS feature, {i} AS pos, CAST({f} AS VARCHAR) AS value, shap__{f} AS shap_eur, {_label_sql(f)} AS description FROM linear"
    for i, f in enumerate(_F))),
    ("drivers", """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY -abs(shap_eur), pos) AS INTEGER) AS place FROM driver_rows) q WHERE place <= 5"""),
    ("driver_texts", """SELECT asset_id, max(prediction) AS prediction, concat('Estimated value is ', format('{:,.0f}', max(prediction)), ' euros. ', upper(substr(body, 1, 1)), substr(body, 2), '.') AS driver_text FROM (
        SELECT asset_id, max(prediction) AS prediction, string_agg(concat(description, CASE WHEN shap_eur >= 0 THEN ' adds ' ELSE ' subtracts ' END, format('{:,.0f}', abs(shap_eur)), ' euros'), ', ' ORDER BY place) AS body
        FROM drivers GROUP BY 1) q GROUP BY asset_id, body""")]


def explained(spark, sf):
    return explain.explain(curate.curated(spark, sf), linear_shap(spark, sf))


@query("describe_feature", on_listings(" UNION ALL ".join(
    f"SELECT asset_id, '{f}' AS feature, {_label_sql(f)} AS description FROM listings" for f in [*labels.BOOLEAN, *labels.CONTINUOUS])
    + """ UNION ALL SELECT asset_id, 'property_type', concat('property type (', property_type, ')') FROM listings
    UNION ALL SELECT asset_id, 'condition', concat('condition (', condition, ')') FROM listings
    UNION ALL SELECT asset_id, 'neighborhood_id', concat('neighborhood (', coalesce(neighborhood_name, 'None'), ')') FROM listings"""))
def describe_feature(spark, sf):
    feats = [*labels.BOOLEAN, *labels.CONTINUOUS, *labels.CATEGORY]
    return curate.curated(spark, sf).select("asset_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), labels.describe(f, F.col(f), F.col("neighborhood_name")).alias("description"))
        for f in feats])).alias("r")).select("asset_id", "r.*")


@query("top_drivers", on_split("""SELECT asset_id, place, feature, round(shap_eur, 6) AS shap_eur, description FROM drivers""", TRAIN, *LINEAR, *DRIVERS))
def top_drivers(spark, sf):
    e = explained(spark, sf).select("asset_id", F.posexplode("top_drivers").alias("place", "d"))
    return e.select("asset_id", (F.col("place") + 1).alias("place"), "d.feature", F.round("d.shap_eur", 6).alias("shap_eur"), "d.description")


@query("driver_text", on_split("SELECT asset_id, driver_text FROM driver_texts", TRAIN, *LINEAR, *DRIVERS))
def driver_text(spark, sf):
    return explained(spark, sf).select("asset_id", "driver_text")


@query("signed_direction", on_split("""SELECT asset_id, feature, CASE WHEN shap_eur >= 0 THEN 'increases' ELSE 'decreases' END AS direction,
    CAST(round_even(shap_eur, 0) AS BIGINT) AS effect_eur FROM drivers""", TRAIN, *LINEAR, *DRIVERS))
def signed_direction(spark, sf):
    e = explained(spark, sf).select("asset_id", F.explode("top_drivers").alias("d"))
    return e.select("asset_id", "d.feature", F.when(F.col("d.shap_eur") >= 0, "increases").otherwise("decreases").alias("direction"),
                    F.rint("d.shap_eur").cast("bigint").alias("effect_eur"))


@query("bar_share", on_split("""SELECT asset_id, feature, round(abs(shap_eur) / max(abs(shap_eur)) OVER (PARTITION BY asset_id) * 100, 6) AS width_pct
    FROM drivers""", TRAIN, *LINEAR, *DRIVERS))
def bar_share(spark, sf):
    e = explained(spark, sf).withColumn("_max", F.array_max(F.transform("top_drivers", lambda d: F.abs(d["shap_eur"]))))
    e = e.select("asset_id", "_max", F.explode("top_drivers").alias("d"))
    return e.select("asset_id", "d.feature", F.round(F.try_divide(F.abs("d.shap_eur"), F.col("_max")) * 100, 6).alias("width_pct"))


@query("global_importance", on_split("SELECT feature, round(m, 6) AS mean_abs_shap, round(m / t, 6) AS share FROM (SELECT *, sum(m) OVER () AS t FROM ("
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs(shap__{f})) AS m FROM linear" for f in _F) + ") q1) q2", TRAIN, *LINEAR))
def global_importance(spark, sf):
    g = explain.global_importance(linear_shap(spark, sf))
    return g.select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"), F.round("share", 6).alias("share"))


@query("cache_or_compute", on_split("""SELECT l.asset_id, round(prediction, 6) AS prediction, split = 'train' AS from_cache FROM linear l
    JOIN split s ON s.asset_id = l.asset_id""", TRAIN, *LINEAR))
def cache_or_compute(spark, sf):
    rows = curate.curated(spark, sf)
    cache = written(linear_shap(spark, sf, train_rows(spark, sf)).withColumn("run_id", F.lit("linear")), "linear-cache")
    out = explain.cache_or_compute(rows, cache, lambda d: linear_shap(spark, sf, d), "linear")
    return out.select("asset_id", F.round("prediction", 6).alias("prediction"), "from_cache")


_FEATS = C.feature_roles().usable


@query("leakage_guard", on_listings(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS non_null, false AS leaks FROM listings" for f in _FEATS)))
def leakage_guard(spark, sf):
    """Fails when a target or leakage column is among the inputs; also says how often each
    input equals the target, which a renamed copy of it would always do."""
    C.assert_no_leakage(_FEATS)
    price = F.col(C.TARGET)
    one = curate.curated(spark, sf).agg(F.count("*").alias("_n"), *[a for f in _FEATS for a in (
        F.count(f).alias(f"n_{f}"), F.count_if(F.col(f).try_cast("double") == price).alias(f"e_{f}"))])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f"n_{f}").alias("non_null"), (F.col(f"e_{f}") == F.col("_n")).alias("leaks"))
        for f in _FEATS])).alias("r")).select("r.*")
