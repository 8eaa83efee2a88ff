"""Sources, derivations and curation as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.functions import rules
from estate_spark.operators import curate, explore, lookup, ranks, spatial
from estate_spark.plans.base_sql import (on_listings, on_pipeline, parcel_edges)
from estate_spark.plans.registry import query
from estate_spark.session import scratch_path
from estate_spark.sources import driver_tables as src
from estate_spark.sources import io

ROLES = C.feature_roles()
CAVEAT = ("Estimates come from 2018 Madrid asking prices; "
          "this is a historical prototype, not a live market feed.")  # fixed value
ZONE_PICK = ["NATION_0", "NATION_6", "NATION_12", "NATION_18"]
PRICE_PICK = (50000, 400000)
_IN = ", ".join(f"'{z}'" for z in ZONE_PICK)


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, sf):
    return io.read_table(spark, sf, "customer")


@query("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_pruned(spark, sf):
    return io.read_table(spark, sf, "lineitem", ["l_orderkey", "l_quantity"])


@query("scan_csv", on_pipeline("""SELECT ASSETID, PERIOD, LISTING_SEQ, PRICE, CONSTRUCTEDAREA, ROOMNUMBER,
    CONSTRUCTIONYEAR, LATITUDE, LONGITUDE FROM raw""", "raw"))
def scan_csv(spark, sf):
    raw = curate.raw(spark, sf).select(
        "ASSETID", "PERIOD", "LISTING_SEQ", "PRICE", "CONSTRUCTEDAREA", "ROOMNUMBER",
        "CONSTRUCTIONYEAR", "LATITUDE", "LONGITUDE")
    path = scratch_path(spark, "raw-csv")
    raw.write.option("header", True).csv(path)
    return io.read_raw_csv(spark, path, raw.schema).drop(io.CORRUPT)


@query("scan_wkt", parcel_edges("""SELECT LOCATIONID, x1, y1, x2, y2,
    min(x1) OVER (PARTITION BY LOCATIONID) AS x_min, max(x1) OVER (PARTITION BY LOCATIONID) AS x_max,
    min(y1) OVER (PARTITION BY LOCATIONID) AS y_min, max(y1) OVER (PARTITION BY LOCATIONID) AS y_max
    FROM parcel_edges"""))
def scan_wkt(spark, sf):
    z = io.load_zones(src.raw_parcels(spark, sf))
    # an inner explode infers a filter on its array, which would parse every text again at the scan
    e = z.select("LOCATIONID", F.explode_outer("edges").alias("e"), "x_min", "x_max", "y_min", "y_max").filter("e is not null")
    return e.select("LOCATIONID", "e.*", "x_min", "x_max", "y_min", "y_max")


@query("sink_parquet", on_pipeline(
    "SELECT asset_id, period, price, area_m2, condition FROM valid", "valid"))
def sink_parquet(spark, sf):
    df = curate.valid(spark, sf).select("asset_id", "period", "price", "area_m2", "condition")
    path = io.write_table(df, scratch_path(spark, "valid-by-condition"), ["condition"])
    return spark.read.parquet(path).select("asset_id", "period", "price", "area_m2", "condition")


@query("sink_csv", on_listings(f"""SELECT asset_id, neighborhood_name, price, area_m2, rooms FROM listings
    WHERE neighborhood_name IN ({_IN}) AND price BETWEEN {PRICE_PICK[0]} AND {PRICE_PICK[1]}"""))
def sink_csv(spark, sf):
    df = explore.explore_filter(curate.curated(spark, sf), ZONE_PICK, *PRICE_PICK).select(
        "asset_id", "neighborhood_name", "price", "area_m2", "rooms")
    path = io.export_csv(df, scratch_path(spark, "export"), CAVEAT)
    return io.read_raw_csv(spark, path, df.schema).drop(io.CORRUPT)


_ASKED = "concat('A', CAST(c_custkey AS VARCHAR(20)))"


@query("point_lookup", on_listings(f"""SELECT k.asset_id, l.price, l.area_m2, l.neighborhood_name,
    l.asset_id IS NOT NULL AS found,
    CASE WHEN l.asset_id IS NULL THEN concat('asset_id ', k.asset_id, ' not found in listings') END AS error
    FROM (SELECT DISTINCT {_ASKED} AS asset_id FROM customer) k LEFT JOIN listings l ON l.asset_id = k.asset_id"""))
def point_lookup(spark, sf):
    keys = io.read_table(spark, sf, "customer").select(F.expr(_ASKED).alias("asset_id"))
    rows = curate.curated(spark, sf).select("asset_id", "price", "area_m2", "neighborhood_name")
    return lookup.lookup(rows, keys)


@query("in_list_lookup", on_listings(f"""SELECT asset_id, latitude, longitude FROM listings WHERE asset_id IN (
    SELECT {_ASKED} FROM customer WHERE c_mktsegment = 'BUILDING')"""))
def in_list_lookup(spark, sf):
    ids = io.read_table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(
        F.expr(_ASKED).alias("asset_id"))
    return lookup.semi_lookup(curate.curated(spark, sf), ids, ["asset_id", "latitude", "longitude"])


_RUNS = """SELECT concat('r', CAST(o_orderkey AS VARCHAR(20))) AS run_id, o_orderstatus AS run_name,
    o_orderdate AS start_time, o_orderpriority = '1-URGENT' AS is_production,
    o_totalprice AS mae FROM {orders}"""


@query("run_log", f"""SELECT run_name, run_id, mae FROM (SELECT *, row_number() OVER (
    PARTITION BY run_name ORDER BY start_time DESC, run_id DESC) AS rn FROM ({_RUNS.format(orders='orders')}) r
    WHERE is_production) q WHERE rn = 1""")
def run_log(spark, sf):
    runs = spark.sql(_RUNS, orders=io.read_table(spark, sf, "orders")).select(
        "run_id", "run_name", "start_time", "is_production",
        F.create_map(F.lit("split_seed"), F.lit("42")).alias("params"),
        F.create_map(F.lit("mae"), F.col("mae")).alias("metrics"))
    path = scratch_path(spark, "runs")
    for tagged in (True, False):
        lookup.append_run(runs.filter(F.col("is_production") == tagged), path)
    log = spark.read.schema(lookup.RUN_SCHEMA).parquet(path)
    return lookup.production_run(log, ["run_name"]).select("run_name", "run_id", F.col("metrics")["mae"].alias("mae"))


# ------------------------------------------------------------- projection and derivation
_RENAMED = list(C.COLUMN_MAP.values())


@query("rename_contract", on_pipeline(
    "SELECT LISTING_SEQ, " + ", ".join(f"{r} AS {n}" for r, n in C.COLUMN_MAP.items()) + " FROM raw", "raw"))
def rename_contract(spark, sf):
    return curate.rename(curate.raw(spark, sf)).select("LISTING_SEQ", *_RENAMED)


@query("project_contract", on_listings("SELECT " + ", ".join(C.NAMES) + " FROM listings"))
def project_contract(spark, sf):
    return C.project_contract(curate.curated(spark, sf))


@query("feature_roles", on_listings("SELECT asset_id, " + ", ".join(ROLES.usable) + " FROM listings"))
def feature_roles(spark, sf):
    return curate.curated(spark, sf).select("asset_id", *ROLES.usable)


_CAND = C.numeric_candidates()


@query("drift_feature_select", on_listings("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS non_null FROM listings HAVING count({c}) > 0" for c in _CAND)))
def drift_feature_select(spark, sf):
    one = curate.curated(spark, sf).agg(*[F.count(c).alias(c) for c in _CAND])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("non_null")) for c in _CAND])).alias("r"))
    return rows.select("r.*").filter("non_null > 0")


@query("cast_types", on_pipeline("""SELECT CAST(asset_id AS VARCHAR) AS asset_id, LISTING_SEQ, CAST(period AS BIGINT) AS period,
    CAST(construction_year AS BIGINT) AS construction_year FROM prepared""", "prepared"))
def cast_types(spark, sf):
    return curate.prepared(curate.raw(spark, sf)).select("asset_id", "LISTING_SEQ", "period", "construction_year")


_TYPED = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN NULL
    ELSE concat(CAST(o_orderkey AS VARCHAR(20)), '.5') END AS entered, o_orderpriority AS word FROM {orders}"""


@query("coerce_numeric", f"""SELECT o_orderkey, TRY_CAST(entered AS DOUBLE) AS entered, TRY_CAST(word AS DOUBLE) AS word
    FROM ({_TYPED.format(orders='orders')}) q""")
def coerce_numeric(spark, sf):
    return rules.coerce_numeric(spark.sql(_TYPED, orders=io.read_table(spark, sf, "orders")), ["entered", "word"])


_NANS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL
    ELSE o_totalprice END AS price FROM {orders}"""


@query("nan_to_null", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_totalprice END AS price
    FROM orders""")
def nan_to_null(spark, sf):
    return rules.nan_to_null(spark.sql(_NANS, orders=io.read_table(spark, sf, "orders")))


@query("range_null_out", on_pipeline("""SELECT LISTING_SEQ, CASE WHEN CONSTRUCTIONYEAR BETWEEN 1900 AND 2018
    THEN CONSTRUCTIONYEAR END AS construction_year FROM raw""", "raw"))
def range_null_out(spark, sf):
    return curate.raw(spark, sf).select("LISTING_SEQ", curate.null_outside(
        "CONSTRUCTIONYEAR", C.YEAR_MIN, C.YEAR_MAX).alias("construction_year"))


@query("onehot_decode", on_pipeline("SELECT LISTING_SEQ, condition FROM prepared", "prepared"))
def onehot_decode(spark, sf):
    return curate.derive(curate.raw(spark, sf)).select("LISTING_SEQ", "condition")


@query("flag_category", on_pipeline("SELECT LISTING_SEQ, property_type FROM prepared", "prepared"))
def flag_category(spark, sf):
    return curate.derive(curate.raw(spark, sf)).select("LISTING_SEQ", "property_type")


@query("derive_age", on_pipeline("SELECT LISTING_SEQ, construction_year, property_age FROM prepared", "prepared"))
def derive_age(spark, sf):
    return curate.prepared(curate.raw(spark, sf)).select("LISTING_SEQ", "construction_year", "property_age")


@query("null_placeholder", on_pipeline("SELECT LISTING_SEQ, cnn_condition_score FROM prepared", "prepared"))
def null_placeholder(spark, sf):
    return curate.prepared(curate.raw(spark, sf)).select("LISTING_SEQ", "cnn_condition_score")


@query("hard_validity", on_pipeline(
    "SELECT asset_id, LISTING_SEQ, price, area_m2, unit_price_m2, latitude, longitude FROM valid", "valid"))
def hard_validity(spark, sf):
    return curate.hard_validity(curate.deduped(spark, sf)).select(
        "asset_id", "LISTING_SEQ", "price", "area_m2", "unit_price_m2", "latitude", "longitude")


@query("dedupe_latest", on_pipeline("SELECT asset_id, period, LISTING_SEQ, price FROM deduped", "deduped"))
def dedupe_latest(spark, sf):
    return curate.deduped(spark, sf).select("asset_id", "period", "LISTING_SEQ", "price")


@query("quantile_bounds", on_pipeline("SELECT * FROM bounds", "bounds"))
def quantile_bounds(spark, sf):
    b = curate.quantile_bounds(curate.valid(spark, sf))
    return b.agg(*[F.max(F.when(F.col("series") == c, F.col(s))).alias(f"{c}_{s}")
                   for c in C.OUTLIER_COLUMNS for s in ("low", "high")])


@query("outlier_trim", on_pipeline("SELECT asset_id, price, area_m2, unit_price_m2 FROM trimmed", "trimmed"))
def outlier_trim(spark, sf):
    return curate.trim_outliers(curate.valid(spark, sf)).select("asset_id", "price", "area_m2", "unit_price_m2")


@query("pip_join", on_listings("SELECT asset_id, latitude, longitude, neighborhood_id, neighborhood_name FROM listings"))
def pip_join(spark, sf):
    pts = curate.trim_outliers(curate.valid(spark, sf)).select("asset_id", "latitude", "longitude")
    return spatial.pip_join(pts, curate.zones(spark, sf))


@query("funnel_counts", on_listings("""SELECT * FROM (
    SELECT 0 AS step, 'raw' AS stage, count(*) AS rows_kept FROM raw
    UNION ALL SELECT 1, 'deduped', count(*) FROM deduped
    UNION ALL SELECT 2, 'valid', count(*) FROM valid
    UNION ALL SELECT 3, 'trimmed', count(*) FROM trimmed
    UNION ALL SELECT 4, 'zone_match', count(neighborhood_id) FROM listings) q"""))
def funnel_counts(spark, sf):
    return curate.funnel(spark, curate.stage_counts(spark, sf))


# ------------------------------------------------------------- row rules
@query("explore_filter", on_listings(f"""
    SELECT 'All' AS selection, asset_id, price FROM listings
    WHERE neighborhood_name IS NOT NULL AND price BETWEEN {PRICE_PICK[0]} AND {PRICE_PICK[1]}
    UNION ALL SELECT 'some', asset_id, price FROM listings
    WHERE neighborhood_name IN ({_IN}) AND price BETWEEN {PRICE_PICK[0]} AND {PRICE_PICK[1]}"""))
def explore_filter(spark, sf):
    df = curate.curated(spark, sf)
    every = explore.explore_filter(df, ["All"], *PRICE_PICK)
    some = explore.explore_filter(df, ZONE_PICK, *PRICE_PICK)
    return (every.select(F.lit("All").alias("selection"), "asset_id", "price")
            .unionByName(some.select(F.lit("some").alias("selection"), "asset_id", "price")))


_YEAR = """CASE WHEN construction_year BETWEEN 1800 AND 2018 THEN construction_year
    WHEN cad_construction_year BETWEEN 1800 AND 2018 THEN cad_construction_year END"""
_YEAR_SRC = """CASE WHEN construction_year BETWEEN 1800 AND 2018 THEN 'construction_year'
    WHEN cad_construction_year BETWEEN 1800 AND 2018 THEN 'cad_construction_year' END"""


@query("effective_year_strict", on_listings(
    f"SELECT asset_id, {_YEAR} AS effective_year, {_YEAR_SRC} AS year_source FROM listings"))
def effective_year_strict(spark, sf):
    return curate.curated(spark, sf).select(
        "asset_id", rules.effective_year().alias("effective_year"), rules.year_source().alias("year_source"))


@query("effective_year_coalesce", on_listings("""SELECT asset_id, coalesce(construction_year, cad_construction_year) AS year
    FROM listings WHERE coalesce(construction_year, cad_construction_year) BETWEEN 1800 AND 2018"""))
def effective_year_coalesce(spark, sf):
    return rules.with_coalesced_year(curate.curated(spark, sf)).select("asset_id", "year")


# subjects entered by hand, one per customer
POSTED_SQL = """SELECT concat('S', CAST(c_custkey AS VARCHAR(20))) AS subject_id,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN CAST(5 AS DOUBLE)
       ELSE CAST(20 + (c_custkey * 37) % 300 AS DOUBLE) END AS area_m2,
  CASE WHEN c_custkey % 19 = 0 THEN CAST(5 AS DOUBLE) / CAST(2 AS DOUBLE) ELSE CAST(c_custkey % 12 AS DOUBLE) END AS rooms,
  CAST(c_custkey % 11 AS DOUBLE) AS bathrooms, CAST(c_custkey % 34 - 2 AS DOUBLE) AS floor,
  CASE WHEN c_custkey % 23 = 0 THEN CAST(1700 AS DOUBLE) ELSE CAST(1900 + c_custkey % 118 AS DOUBLE) END AS construction_year,
  CASE WHEN c_custkey % 3 = 0 THEN 'studio' WHEN c_custkey % 3 = 1 THEN 'duplex' ELSE 'flat' END AS property_type,
  CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'good' END AS condition,
  CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE CAST(403000 + (c_custkey * 7919) % 3000 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS latitude,
  CAST((c_custkey * 104729) % 3500 - 39000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS longitude,
  concat('Z', lpad(CAST(c_nationkey AS VARCHAR(20)), 2, '0')) AS neighborhood_id,
  c_acctbal AS cnn_condition_score, c_mktsegment AS extra_note
FROM {customer}"""


def posted(spark, sf):
    return spark.sql(POSTED_SQL, customer=io.read_table(spark, sf, "customer"))


_POSTED = POSTED_SQL.format(customer="customer")
_GIVEN = {"area_m2": "DOUBLE", "rooms": "BIGINT", "bathrooms": "BIGINT", "floor": "BIGINT",
          "construction_year": "BIGINT", "property_type": "VARCHAR", "condition": "VARCHAR",
          "latitude": "DOUBLE", "longitude": "DOUBLE", "neighborhood_id": "VARCHAR"}


@query("backfill_columns", "SELECT subject_id, " + ", ".join(
    (f"CAST(floor({c}) AS BIGINT) AS {c}" if _GIVEN[c] == "BIGINT" else c) if c in _GIVEN
    else f"CAST(NULL AS {'BIGINT' if C.TYPES[c] == C.INT else 'DOUBLE'}) AS {c}"
    for c in ROLES.usable) + f" FROM ({_POSTED}) p")
def backfill_columns(spark, sf):
    return rules.align(posted(spark, sf), ROLES.usable, C.TYPES, ["subject_id"])


_CHECK_SQL = "".join(
    f" WHEN {c} IS NULL OR NOT ({c} BETWEEN {lo} AND {hi}{f' AND {c} = floor({c})' if whole else ''}) THEN '{msg}'"
    for c, lo, hi, whole, msg in rules.FORM_RULES)


@query("input_bounds_check", f"""SELECT subject_id, CASE {_CHECK_SQL}
    WHEN latitude IS NULL OR longitude IS NULL THEN '{rules.NO_LOCATION}' END AS error FROM ({_POSTED}) p""")
def input_bounds_check(spark, sf):
    return posted(spark, sf).select("subject_id", rules.form_error().alias("error"))
