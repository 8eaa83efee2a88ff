"""Comparables and energy as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.functions import geo, rules
from estate_spark.operators import comps, curate, energy, quality
from estate_spark.plans.base_sql import on_listings
from estate_spark.plans.curation import _YEAR, _YEAR_SRC
from estate_spark.plans.registry import query
from estate_spark.session import once, written

_SUBJECT = ["property_type", "latitude", "longitude", "area_m2", "rooms"]


def subjects(spark, sf):
    """Every listing as a subject."""
    return curate.curated(spark, sf).withColumn("subject_id", F.col("asset_id"))


def all_comps(spark, sf):
    return once(spark, ("comps", sf), lambda: written(
        comps.comparables(subjects(spark, sf), curate.curated(spark, sf)), "comps"))


_HAV = ("2.0::DOUBLE * 6371.0::DOUBLE * asin(sqrt(sin((radians({p}.latitude) - radians({s}.latitude)) / 2) * sin((radians({p}.latitude) - radians({s}.latitude)) / 2)"
        " + cos(radians({s}.latitude)) * cos(radians({p}.latitude)) * sin((radians({p}.longitude) - radians({s}.longitude)) / 2) * sin((radians({p}.longitude) - radians({s}.longitude)) / 2)))")
PAIRS = ("pairs", f"""SELECT *, distance_km + area_diff_m2 / 20::DOUBLE + 0.7::DOUBLE * rooms_diff AS score FROM (
    SELECT s.asset_id AS subject_id, s.area_m2 AS s_area_m2, s.rooms AS s_rooms, p.asset_id, p.price, p.area_m2, p.rooms, p.bathrooms,
      p.property_type, p.neighborhood_name, p.latitude, p.longitude,
      {_HAV.format(s='s', p='p')} AS distance_km, abs(p.area_m2 - s.area_m2) AS area_diff_m2, abs(p.rooms - s.rooms) AS rooms_diff
    FROM listings s JOIN listings p ON p.property_type = s.property_type AND p.asset_id <> s.asset_id) q""")
COMPS = ("comps", """SELECT *, concat(format('{:.2f}', distance_km), ' km from the subject, ', format('{:.0f}', area_m2), ' m2 vs ',
      format('{:.0f}', s_area_m2), ' m2, ', CAST(rooms AS VARCHAR), ' rooms vs ', CAST(s_rooms AS VARCHAR), ', same property type (', property_type, ')') AS why
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY score, asset_id) AS INTEGER) AS rank FROM pairs) q WHERE rank <= 5""")


@query("haversine_km", on_listings(f"""SELECT s.asset_id, round({_HAV.format(s='c', p='s')}, 6) AS distance_km
    FROM listings s, (SELECT 40.4168::DOUBLE AS latitude, -3.7038::DOUBLE AS longitude) c"""))
def haversine_km(spark, sf):
    centre = (F.lit(40.4168), F.lit(-3.7038))
    return curate.curated(spark, sf).select("asset_id", F.round(geo.haversine_km(
        *centre, F.col("latitude"), F.col("longitude")), 6).alias("distance_km"))


@query("similarity_score", on_listings(f"""SELECT s.asset_id, round({_HAV.format(s='c', p='s')} + abs(s.area_m2 - 90) / 20::DOUBLE
    + 0.7::DOUBLE * abs(s.rooms - 3), 6) AS score FROM listings s, (SELECT 40.4168::DOUBLE AS latitude, -3.7038::DOUBLE AS longitude) c"""))
def similarity_score(spark, sf):
    km = geo.haversine_km(F.lit(40.4168), F.lit(-3.7038), F.col("latitude"), F.col("longitude"))
    return curate.curated(spark, sf).select("asset_id", F.round(geo.score(
        km, F.abs(F.col("area_m2") - 90), F.abs(F.col("rooms") - 3)), 6).alias("score"))


_COMP_COLS = ["subject_id", "rank", "asset_id", "price", "area_m2", "rooms", "bathrooms", "property_type",
              "neighborhood_name", "area_diff_m2", "rooms_diff"]


@query("comparables", on_listings(f"""SELECT {', '.join(_COMP_COLS)}, round(distance_km, 6) AS distance_km, round(score, 6) AS score
    FROM comps""", PAIRS, COMPS))
def comparables(spark, sf):
    c = comps.comparables(subjects(spark, sf), curate.curated(spark, sf))
    return c.select(*_COMP_COLS, F.round("distance_km", 6).alias("distance_km"), F.round("score", 6).alias("score"))


@query("comparables_topk", on_listings("""SELECT subject_id, rank, asset_id, round(score, 6) AS score FROM (
      SELECT 'centre' AS subject_id, CAST(row_number() OVER (ORDER BY score, asset_id) AS INTEGER) AS rank, asset_id, score FROM (
      SELECT s.asset_id, """ + _HAV.format(s='c', p='s') + """ + abs(s.area_m2 - 90) / 20::DOUBLE + 0.7::DOUBLE * abs(s.rooms - 3) AS score
      FROM listings s, (SELECT 40.4168::DOUBLE AS latitude, -3.7038::DOUBLE AS longitude) c WHERE property_type = 'flat') q1) q2 WHERE rank <= 5"""))
def comparables_topk(spark, sf):
    """One subject without an id, entered by hand."""
    one = curate.curated(spark, sf).agg(F.lit("flat").alias("property_type")).select(
        F.lit("centre").alias("subject_id"), F.lit(None).cast("string").alias("asset_id"), "property_type",
        F.lit(40.4168).alias("latitude"), F.lit(-3.7038).alias("longitude"), F.lit(90.0).alias("area_m2"), F.lit(3).alias("rooms"))
    return comps.comparables(one, curate.curated(spark, sf)).select("subject_id", "rank", "asset_id", F.round("score", 6).alias("score"))


@query("comp_why", on_listings("SELECT subject_id, asset_id, why FROM comps", PAIRS, COMPS))
def comp_why(spark, sf):
    return all_comps(spark, sf).select("subject_id", "asset_id", "why")


@query("comps_summary", on_listings("""SELECT subject_id, count(*) AS n, min(price) AS price_min, max(price) AS price_max,
    round(quantile_cont(price, 0.5), 6) AS price_median, round(max(distance_km), 6) AS max_distance_km FROM comps GROUP BY 1""", PAIRS, COMPS))
def comps_summary(spark, sf):
    s = comps.comps_summary(all_comps(spark, sf))
    return s.select("subject_id", "n", "price_min", "price_max", F.round("price_median", 6).alias("price_median"),
                    F.round("max_distance_km", 6).alias("max_distance_km"))


@query("comps_are_real", on_listings("""SELECT subject_id, true AS exist_once, true AS same_price, true AS same_type, true AS not_self,
    count(*) AS n FROM comps GROUP BY 1""", PAIRS, COMPS))
def comps_are_real(spark, sf):
    return quality.check_comps(all_comps(spark, sf), curate.curated(spark, sf))


@query("map_points", on_listings("""SELECT asset_id AS subject_id, 'subject' AS role, latitude, longitude, concat('Subject (', asset_id, ')') AS label, 90 AS radius
    FROM listings UNION ALL SELECT subject_id, 'comp', latitude, longitude, concat('Comp (', asset_id, ', EUR ', format('{:,.0f}', price), ')'), 60 FROM comps""",
    PAIRS, COMPS))
def map_points(spark, sf):
    return comps.map_points(subjects(spark, sf), all_comps(spark, sf))


BAND = ("band", f"""SELECT asset_id AS subject_id, CASE WHEN condition = 'new' THEN 'C' WHEN y IS NULL THEN 'unknown' WHEN y >= 2007 THEN 'C'
      WHEN y >= 1980 THEN 'E' ELSE 'F' END AS band, y AS effective_year,
      CASE WHEN condition = 'new' THEN coalesce(src, 'condition') ELSE src END AS year_source,
      condition <> 'new' AND y IS NOT NULL AND y < 1980 AS flag
    FROM (SELECT *, {_YEAR} AS y, {_YEAR_SRC} AS src FROM listings) q""")
_SEG = """count(*) FILTER (WHERE y <= 1979) AS n_old, count(*) FILTER (WHERE y >= 2007) AS n_new,
      quantile_cont(unit_price_m2, 0.5) FILTER (WHERE y <= 1979) AS m_old, quantile_cont(unit_price_m2, 0.5) FILTER (WHERE y >= 2007) AS m_new"""
GAP = [("dated", """SELECT * FROM (SELECT *, coalesce(construction_year, cad_construction_year) AS y FROM listings) q WHERE y BETWEEN 1800 AND 2018"""),
       ("zone_seg", f"SELECT neighborhood_id, {_SEG} FROM dated WHERE neighborhood_id IS NOT NULL GROUP BY 1"),
       ("city_seg", f"SELECT {_SEG} FROM dated"),
       ("gap", """SELECT subject_id, scope, n_old, n_new, median_old_eur_m2, median_new_eur_m2, median_new_eur_m2 - median_old_eur_m2 AS gap_eur_m2,
          subject_area_m2, (median_new_eur_m2 - median_old_eur_m2) * subject_area_m2 AS subject_gap_eur FROM (
          SELECT subject_id, scope, n_old, n_new, CAST(round_even(m_old, 0) AS BIGINT) AS median_old_eur_m2,
            CAST(round_even(m_new, 0) AS BIGINT) AS median_new_eur_m2, CAST(round_even(area_m2, 0) AS BIGINT) AS subject_area_m2 FROM (
            SELECT l.asset_id AS subject_id, l.area_m2, z.n_old >= 20 AND z.n_new >= 20 AS is_local,
              CASE WHEN z.n_old >= 20 AND z.n_new >= 20 THEN concat('barrio ', neighborhood_name) WHEN c.n_old >= 20 AND c.n_new >= 20 THEN 'Madrid citywide' END AS scope,
              CASE WHEN z.n_old >= 20 AND z.n_new >= 20 THEN z.n_old WHEN c.n_old >= 20 AND c.n_new >= 20 THEN c.n_old END AS n_old,
              CASE WHEN z.n_old >= 20 AND z.n_new >= 20 THEN z.n_new WHEN c.n_old >= 20 AND c.n_new >= 20 THEN c.n_new END AS n_new,
              CASE WHEN z.n_old >= 20 AND z.n_new >= 20 THEN z.m_old WHEN c.n_old >= 20 AND c.n_new >= 20 THEN c.m_old END AS m_old,
              CASE WHEN z.n_old >= 20 AND z.n_new >= 20 THEN z.m_new WHEN c.n_old >= 20 AND c.n_new >= 20 THEN c.m_new END AS m_new
            FROM listings l LEFT JOIN zone_seg z ON z.neighborhood_id = l.neighborhood_id CROSS JOIN city_seg c) q1) q2""")]


@query("energy_band", on_listings("SELECT * FROM band", BAND))
def energy_band(spark, sf):
    return rules.with_energy_band(subjects(spark, sf)).select("subject_id", "band", "effective_year", "year_source", "flag")


@query("segment_gap", on_listings("""SELECT subject_id, scope, n_old, n_new, median_old_eur_m2, median_new_eur_m2, gap_eur_m2,
    CASE WHEN scope IS NOT NULL THEN subject_area_m2 END AS subject_area_m2, subject_gap_eur FROM gap""", *GAP))
def segment_gap(spark, sf):
    return energy.segment_gap(subjects(spark, sf), curate.curated(spark, sf)).select("subject_id", "impact.*")


@query("round_half_even", on_listings("""SELECT asset_id, CAST(round_even(area_m2 / 2, 0) AS BIGINT) AS half_area,
    CAST(round_even(unit_price_m2, 0) AS BIGINT) AS eur_m2 FROM listings"""))
def round_half_even(spark, sf):
    return curate.curated(spark, sf).select("asset_id", F.rint(F.col("area_m2") / 2).cast("bigint").alias("half_area"),
                                            F.rint("unit_price_m2").cast("bigint").alias("eur_m2"))
