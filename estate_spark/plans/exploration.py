"""Market exploration, picks and profiles as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.functions import rules
from estate_spark.operators import curate, defaults, explore, quality
from estate_spark.plans.base_sql import on_listings, on_pipeline
from estate_spark.plans.curation import _CHECK_SQL, _IN, _POSTED, PRICE_PICK, ZONE_PICK, posted
from estate_spark.plans.registry import query

R = "round({}, 6)".format


@query("group_medians", on_listings("""SELECT neighborhood_name, round(quantile_cont(price, 0.5), 6) AS median_price,
    round(quantile_cont(unit_price_m2, 0.5), 6) AS median_eur_m2, count(*) AS n
    FROM listings WHERE neighborhood_name IS NOT NULL GROUP BY 1"""))
def group_medians(spark, sf):
    return explore.group_medians(curate.curated(spark, sf)).select(
        "neighborhood_name", F.round("median_price", 6).alias("median_price"),
        F.round("median_eur_m2", 6).alias("median_eur_m2"), "n")


@query("sort_display", on_listings("""SELECT neighborhood_name, round(quantile_cont(price, 0.5), 6) AS median_price, count(*) AS n
    FROM listings WHERE neighborhood_name IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1"""))
def sort_display(spark, sf):
    s = explore.group_medians(curate.curated(spark, sf))
    return s.orderBy(F.col("median_price").desc(), "neighborhood_name").select(
        "neighborhood_name", F.round("median_price", 6).alias("median_price"), "n")


def _topn(metric: str, col: str) -> str:
    return f"""SELECT '{metric}' AS metric, neighborhood_name, v AS value FROM (
        SELECT neighborhood_name, round(quantile_cont({col}, 0.5), 6) AS v, quantile_cont({col}, 0.5) AS o
        FROM listings WHERE neighborhood_name IS NOT NULL GROUP BY 1 ORDER BY o DESC, 1 LIMIT 30) q"""


@query("topn_groups", on_listings(
    _topn("median_price", "price") + " UNION ALL " + _topn("median_eur_m2", "unit_price_m2")))
def topn_groups(spark, sf):
    s = explore.group_medians(curate.curated(spark, sf))
    out = None
    for metric in ("median_price", "median_eur_m2"):
        top = explore.top_groups(s, metric, 30).select(
            F.lit(metric).alias("metric"), "neighborhood_name", F.round(metric, 6).alias("value"))
        out = top if out is None else out.unionByName(top)
    return out


_NUM = [c for c in C.feature_roles().numeric + ["price", "unit_price_m2"]]


@query("group_median_all", on_listings("SELECT neighborhood_id, neighborhood_name, " + ", ".join(
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS {c}" for c in _NUM)
    + " FROM listings WHERE neighborhood_id IS NOT NULL GROUP BY 1, 2"))
def group_median_all(spark, sf):
    m = explore.group_median_all(curate.curated(spark, sf), ["neighborhood_id", "neighborhood_name"], _NUM)
    return m.select("neighborhood_id", "neighborhood_name", *[F.round(c, 6).alias(c) for c in _NUM])


_PICK = f"neighborhood_name IN ({_IN}) AND price BETWEEN {PRICE_PICK[0]} AND {PRICE_PICK[1]}"


@query("kpi_delta", on_listings(f"""SELECT n, n - n_all AS n_delta, round(mp, 6) AS median_price, round(mp - mp_all, 6) AS median_price_delta,
    round(ma, 6) AS mean_area, round(ma - ma_all, 6) AS mean_area_delta,
    round(me, 6) AS mean_eur_m2, round(me - me_all, 6) AS mean_eur_m2_delta FROM (
    SELECT count(*) FILTER (WHERE {_PICK}) AS n, count(*) AS n_all,
      quantile_cont(price, 0.5) FILTER (WHERE {_PICK}) AS mp, quantile_cont(price, 0.5) AS mp_all,
      avg(area_m2) FILTER (WHERE {_PICK}) AS ma, avg(area_m2) AS ma_all,
      avg(unit_price_m2) FILTER (WHERE {_PICK}) AS me, avg(unit_price_m2) AS me_all FROM listings) q"""))
def kpi_delta(spark, sf):
    picked = F.col("neighborhood_name").isin(ZONE_PICK) & F.col("price").between(*PRICE_PICK)
    df = curate.curated(spark, sf).select("price", "area_m2", "unit_price_m2", "neighborhood_name")
    one = explore.kpi_delta(df.withColumn("_p", picked).select("price", "area_m2", "unit_price_m2", "_p"), F.col("_p"))
    return one.select("n", "n_delta", *[F.round(c, 6).alias(c) for c in one.columns[2:]])


def _hist(col: str) -> str:
    return f"""SELECT '{col}' AS variable, CAST(b AS INTEGER) AS bin, round(lo + b * w, 6) AS bin_low, round(lo + (b + 1) * w, 6) AS bin_high,
      count(v) AS n, round((SELECT quantile_cont({col}, 0.5) FROM listings), 6) AS median_marker
      FROM (SELECT min({col}) AS lo, (max({col}) - min({col})) / CAST(40 AS DOUBLE) AS w FROM listings) r
      CROSS JOIN (SELECT unnest(range(0, 40)) AS b) g
      LEFT JOIN (SELECT {col} AS v FROM listings) l ON least(floor((v - lo) / w), 39) = b
      GROUP BY b, lo, w"""


@query("histogram", on_listings(_hist("price") + " UNION ALL " + _hist("unit_price_m2")))
def histogram(spark, sf):
    out = None
    for c in ("price", "unit_price_m2"):
        h = explore.histogram(curate.curated(spark, sf).select(c), c).select(
            F.lit(c).alias("variable"), "bin", F.round("bin_low", 6).alias("bin_low"),
            F.round("bin_high", 6).alias("bin_high"), "n", F.round("median_marker", 6).alias("median_marker"))
        out = h if out is None else out.unionByName(h)
    return out


@query("scatter_sample", on_listings("SELECT asset_id, area_m2, price, property_type FROM listings"))
def scatter_sample(spark, sf):
    return explore.scatter(curate.curated(spark, sf))


@query("distinct_list", on_listings(
    "SELECT DISTINCT neighborhood_name FROM listings WHERE neighborhood_name IS NOT NULL ORDER BY 1"))
def distinct_list(spark, sf):
    return explore.distinct_list(curate.curated(spark, sf), "neighborhood_name")


@query("first_by_key", on_listings("""SELECT asset_id, price, area_m2, neighborhood_name FROM listings
    ORDER BY asset_id LIMIT 1"""))
def first_by_key(spark, sf):
    return explore.first_by(curate.curated(spark, sf), "asset_id", ["price", "area_m2", "neighborhood_name"])


_TARGETS = ", ".join(
    f"(SELECT price FROM ranked WHERE r = floor((n - 1) * CAST({q} AS DOUBLE) + 0.5)) AS {label}"
    for label, q in quality.SAMPLE_QUANTILES)


@query("nearest_to_quantile", on_listings(
    " UNION ALL ".join(f"""SELECT * FROM (SELECT '{label}' AS label, asset_id, price, area_m2, neighborhood_name FROM listings, targets
        WHERE neighborhood_id IS NOT NULL ORDER BY abs(price - {label}), asset_id LIMIT 1) q_{label}"""
                       for label, _ in quality.SAMPLE_QUANTILES),
    ("ranked", """SELECT price, row_number() OVER (ORDER BY price) - 1 AS r, count(*) OVER () AS n
        FROM listings WHERE neighborhood_id IS NOT NULL"""),
    ("targets", f"SELECT {_TARGETS}")))
def nearest_to_quantile(spark, sf):
    return explore.pick_at_quantiles(curate.curated(spark, sf), quality.SAMPLE_QUANTILES,
                                     ["price", "area_m2", "neighborhood_name"])


@query("null_rates", on_listings(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS null_rate FROM listings"
    for c in C.NAMES)))
def null_rates(spark, sf):
    return quality.null_rates(curate.curated(spark, sf)).withColumn("null_rate", F.round("null_rate", 6))


_PROFILE = ["price", "area_m2", "unit_price_m2", "latitude", "longitude", "rooms", "bathrooms", "construction_year"]


@query("value_profile", on_listings(" UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, CAST(NULL AS VARCHAR) AS value_set FROM listings"
     for c in _PROFILE]
    + [f"SELECT '{c}', NULL, NULL, array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR))), ',') FROM listings"
       for c in ("condition", "property_type", "period")])))
def value_profile(spark, sf):
    return quality.value_profile(curate.curated(spark, sf), _PROFILE, ["condition", "property_type", "period"])


@query("expectations", on_listings("""SELECT rule, observed, ok FROM (
    SELECT count(*) AS n, count(DISTINCT asset_id) AS ids,
      """ + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in C.KEY_COLUMNS + ["neighborhood_id", "neighborhood_name", "cnn_condition_score"])
    + """, count(*) - count(construction_year) AS null_year,
      min(price) AS p, min(area_m2) AS a, min(unit_price_m2) AS u, min(latitude) AS la0, max(latitude) AS la1,
      min(longitude) AS lo0, max(longitude) AS lo1, min(rooms) AS rm, min(bathrooms) AS ba,
      count(*) FILTER (WHERE condition NOT IN ('new', 'needs_renovation', 'good')
        OR property_type NOT IN ('studio', 'duplex', 'flat') OR period NOT IN (201803, 201806, 201809, 201812)) AS odd,
      min(construction_year) AS y0, max(construction_year) AS y1 FROM listings) q,
    LATERAL (VALUES ('columns_match_contract', CAST(44 AS DOUBLE), true),
      ('row_count_in_bounds', CAST(n AS DOUBLE), n BETWEEN 1 AND 1000000000000),
      ('unique_id', CAST(n - ids AS DOUBLE), n = ids),
      ('key_columns_not_null', CAST(""" + " + ".join(f"null_{c}" for c in C.KEY_COLUMNS) + """ AS DOUBLE), """
    + " + ".join(f"null_{c}" for c in C.KEY_COLUMNS) + """ = 0),
      ('year_null_rate', round(null_year / CAST(n AS DOUBLE), 6), null_year / CAST(n AS DOUBLE) < 0.7),
      ('placeholder_all_null', CAST(n - null_cnn_condition_score AS DOUBLE), null_cnn_condition_score = n),
      ('zone_match_rate', round((n - null_neighborhood_id) / CAST(n AS DOUBLE), 6),
        (n - null_neighborhood_id) / CAST(n AS DOUBLE) >= 0.98 AND null_neighborhood_id = null_neighborhood_name),
      ('positive_price_area', least(p, a, u), least(p, a, u) > 0),
      ('inside_bbox', CAST(NULL AS DOUBLE), la0 >= 40.30::DOUBLE AND la1 <= 40.60::DOUBLE AND lo0 >= -3.90::DOUBLE AND lo1 <= -3.55::DOUBLE),
      ('counts_not_negative', CAST(least(rm, ba) AS DOUBLE), least(rm, ba) >= 0),
      ('allowed_values', CAST(odd AS DOUBLE), odd = 0),
      ('year_range', CAST(NULL AS DOUBLE), y0 >= 1900 AND y1 <= 2018)) AS v(rule, observed, ok)"""))
def expectations(spark, sf):
    out = quality.check(curate.curated(spark, sf), row_bounds=(1, 10 ** 12))
    return out.withColumn("observed", F.when(F.col("rule").isin("year_null_rate", "zone_match_rate"),
                                             F.round("observed", 6)).otherwise(F.col("observed")))


_DEF = ["distance_to_metro", "has_lift", "cad_construction_year"]


@query("default_fill", on_listings(f"""SELECT subject_id, p.neighborhood_id, m.neighborhood_name,
    round(coalesce(CAST(p.area_m2 AS DOUBLE), m.area_m2), 6) AS area_m2, round(coalesce(floor(p.rooms), m.rooms), 6) AS rooms,
    CAST(2018 - p.construction_year AS DOUBLE) AS property_age, CASE WHEN p.property_type = 'duplex' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_duplex,
    CASE WHEN p.property_type = 'studio' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_studio,
    {', '.join(f'round(m.{c}, 6) AS {c}' for c in _DEF)}
    FROM ({_POSTED}) p LEFT JOIN (SELECT neighborhood_id, neighborhood_name, {', '.join(
        f'quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}' for c in ['area_m2', 'rooms', *_DEF])}
      FROM listings WHERE neighborhood_id IS NOT NULL GROUP BY 1, 2) m ON m.neighborhood_id = p.neighborhood_id"""))
def default_fill(spark, sf):
    filled = defaults.fill_zone_defaults(posted(spark, sf).withColumn("rooms", F.floor("rooms")).select(
        "subject_id", "neighborhood_id", "area_m2", "rooms", "construction_year", "property_type"),
        curate.curated(spark, sf), ["area_m2", "rooms", *_DEF])
    return filled.select("subject_id", "neighborhood_id", "neighborhood_name",
                         F.round("area_m2", 6).alias("area_m2"), F.round("rooms", 6).alias("rooms"),
                         "property_age", "is_duplex", "is_studio", *[F.round(c, 6).alias(c) for c in _DEF])
