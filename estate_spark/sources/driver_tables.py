"""Listing snapshots, zones and parcels as views over the given order tables.

An order is a snapshot of a listing, its customer the asset that is listed again over
time, its lines give size and rooms. The text below is valid in Spark and in ANSI SQL
engines; coordinates are integer arithmetic followed by one double division, so that
every engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estate_spark.session import spread
from estate_spark.sources.io import read_table

RAW_LISTINGS_SQL = """
SELECT concat('A', CAST(o_custkey AS VARCHAR(20))) AS ASSETID,
  CAST(year(o_orderdate) * 100 + quarter(o_orderdate) * 3 AS BIGINT) AS PERIOD,
  o_orderkey AS LISTING_SEQ, o_totalprice AS PRICE, q AS CONSTRUCTEDAREA,
  o_totalprice / q AS UNITPRICE, n AS ROOMNUMBER, 1 + o_orderkey % 3 AS BATHNUMBER,
  o_orderkey % 9 - 1 AS FLOORCLEAN,
  CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS ISSTUDIO,
  CASE WHEN o_orderkey % 20 = 1 THEN 1 ELSE 0 END AS ISDUPLEX,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS BUILTTYPEID_1,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS BUILTTYPEID_2,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS BUILTTYPEID_3,
  CASE WHEN o_orderkey % 10 < 3 THEN 2007 + o_orderkey % 14
       WHEN o_orderkey % 10 < 5 THEN NULL
       WHEN o_orderkey % 10 = 5 THEN 1980 + o_orderkey % 27
       ELSE 1890 + o_orderkey % 90 END AS CONSTRUCTIONYEAR,
  CASE WHEN o_orderkey % 97 = 0 THEN 1623 ELSE 1900 + o_orderkey % 119 END AS CADCONSTRUCTIONYEAR,
  CAST(402800 + ((o_custkey - o_custkey % 3) * 7919) % 3400 AS DOUBLE) / CAST(10000 AS DOUBLE) AS LATITUDE,
  CAST(((o_custkey - o_custkey % 3) * 104729) % 3900 - 39200 AS DOUBLE) / CAST(10000 AS DOUBLE) AS LONGITUDE,
  o_orderkey % 2 AS HASTERRACE,
  CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS HASLIFT,
  CASE WHEN o_orderkey % 5 < 2 THEN 1 ELSE 0 END AS HASAIRCONDITIONING,
  CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 0 END AS HASPARKINGSPACE,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS ISPARKINGSPACEINCLUDEDINPRICE,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(100 * (o_orderkey % 250) AS DOUBLE)
       ELSE CAST(0 AS DOUBLE) END AS PARKINGSPACEPRICE,
  CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS HASNORTHORIENTATION,
  CASE WHEN o_orderkey % 6 IN (1, 2) THEN 1 ELSE 0 END AS HASSOUTHORIENTATION,
  CASE WHEN o_orderkey % 6 = 3 THEN 1 ELSE 0 END AS HASEASTORIENTATION,
  CASE WHEN o_orderkey % 6 = 4 THEN 1 ELSE 0 END AS HASWESTORIENTATION,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS HASBOXROOM,
  CASE WHEN o_orderkey % 7 < 4 THEN 1 ELSE 0 END AS HASWARDROBE,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS HASSWIMMINGPOOL,
  CASE WHEN o_orderkey % 11 < 4 THEN 1 ELSE 0 END AS HASDOORMAN,
  CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS HASGARDEN,
  CASE WHEN o_orderkey % 13 < 2 THEN 1 ELSE 0 END AS ISINTOPFLOOR,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END AS AMENITYID,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END AS FLATLOCATIONID,
  1 + o_orderkey % 14 AS CADMAXBUILDINGFLOOR,
  1 + o_orderkey % 83 AS CADDWELLINGCOUNT,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderkey % 10 END AS CADASTRALQUALITYID,
  CAST((o_custkey * 613) % 1500 AS DOUBLE) / CAST(100 AS DOUBLE) AS DISTANCE_TO_CITY_CENTER,
  CAST((o_custkey * 331) % 400 AS DOUBLE) / CAST(100 AS DOUBLE) AS DISTANCE_TO_METRO,
  CAST((o_custkey * 877) % 1200 AS DOUBLE) / CAST(100 AS DOUBLE) AS DISTANCE_TO_CASTELLANA
FROM {orders} LEFT JOIN (
  SELECT l_orderkey, SUM(l_quantity) AS q, COUNT(*) AS n FROM {lineitem} GROUP BY l_orderkey
) AS li ON o_orderkey = l_orderkey
"""


def _coord(units: str) -> str:
    """SQL text of an integer count of 1e-5 degrees as decimal degrees."""
    digits = f"CAST(abs({units}) % 100000 AS VARCHAR(20))"
    whole = f"CAST(CAST(floor(abs({units}) / 100000) AS BIGINT) AS VARCHAR(20))"
    return (f"concat(CASE WHEN {units} < 0 THEN '-' ELSE '' END, {whole}, '.', "
            f"lpad({digits}, 5, '0'))")


def _ring(corners: list[tuple[str, str]]) -> str:
    parts = []
    for x, y in corners + corners[:1]:
        parts.append(f"concat({_coord(x)}, ' ', {_coord(y)})")
    return "concat('(', concat_ws(', ', " + ", ".join(parts) + "), ')')"


# 25 sheared quadrilaterals of unequal size, one per nation, on the half steps of the
# coordinate lattice so that no listing lies on an edge; one of them has a hole.
_X0 = "(CASE i WHEN 0 THEN -390005 WHEN 1 THEN -379505 WHEN 2 THEN -370755 WHEN 3 THEN -363755 ELSE -358505 END)"
_X1 = "(CASE i WHEN 0 THEN -379565 WHEN 1 THEN -370815 WHEN 2 THEN -363815 WHEN 3 THEN -358565 ELSE -354995 END)"
_Y0 = "(CASE j WHEN 0 THEN 4029995 WHEN 1 THEN 4038995 WHEN 2 THEN 4046495 WHEN 3 THEN 4052495 ELSE 4056995 END)"
_Y1 = "(CASE j WHEN 0 THEN 4038995 WHEN 1 THEN 4046455 WHEN 2 THEN 4052495 WHEN 3 THEN 4056995 ELSE 4060005 END)"

ZONES_SQL = f"""
SELECT concat('Z', lpad(CAST(n_nationkey AS VARCHAR(20)), 2, '0')) AS LOCATIONID,
  n_name AS LOCATIONNAME, 8 AS ZONELEVELID,
  concat('MULTIPOLYGON((',
    {_ring([(_X0, _Y0), (_X1, _Y0), (_X1 + " + 40", _Y1), (_X0 + " + 40", _Y1)])},
    CASE WHEN n_nationkey = 6 THEN concat(', ',
    {_ring([(_X0 + " + 3000", _Y0 + " + 3000"), (_X0 + " + 3000", _Y0 + " + 4000"),
            (_X0 + " + 4000", _Y0 + " + 4000"), (_X0 + " + 4000", _Y0 + " + 3000")])})
    ELSE '' END, '))') AS wkt
FROM (SELECT n_nationkey, n_name, n_nationkey % 5 AS i,
             CAST(floor(n_nationkey / 5) AS INT) AS j FROM {{nation}}) AS nz
"""

# one small parcel polygon per customer, for reading WKT at volume
_PX, _PY = "(-390000 + 10 * ((c_custkey * 104729) % 3500))", "(4030000 + 10 * ((c_custkey * 7919) % 3000))"
PARCELS_SQL = f"""
SELECT concat('P', CAST(c_custkey AS VARCHAR(20))) AS LOCATIONID, c_name AS LOCATIONNAME,
  concat('MULTIPOLYGON((',
    {_ring([(_PX, _PY), (_PX + " + 9", _PY), (_PX + " + 9", _PY + " + 7"), (_PX, _PY + " + 7")])},
    CASE WHEN c_custkey % 4 = 0 THEN concat(', ',
    {_ring([(_PX + " + 2", _PY + " + 2"), (_PX + " + 4", _PY + " + 2"), (_PX + " + 3", _PY + " + 4")])})
    ELSE '' END, '))') AS wkt
FROM {{customer}}
"""


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        RAW_LISTINGS_SQL,
        orders=read_table(spark, sf_dir, "orders"),
        lineitem=read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"]))


def raw_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ZONES_SQL, nation=read_table(spark, sf_dir, "nation"))


def raw_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are made and parsed row by row, and the key column is a small file
    return spark.sql(PARCELS_SQL, customer=spread(read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])))
