"""Check SQL: the pipeline's tables as common table expressions over the given tables."""

from __future__ import annotations

from estate_spark import contract as C
from estate_spark.sources import driver_tables as src

_RAW = src.RAW_LISTINGS_SQL.format(orders="orders", lineitem="lineitem")
_RENAMES = ", ".join(f"{raw} AS {name}" for raw, name in C.COLUMN_MAP.items()
                     if name != "construction_year")
_B = C.BBOX


def _edges(source: str, prefix: str) -> list[tuple[str, str]]:
    return [
        (f"{prefix}_rings", f"""SELECT LOCATIONID, LOCATIONNAME, r AS ring_no, rings[r] AS ring FROM (
            SELECT *, unnest(range(1, len(rings) + 1)) AS r FROM (
              SELECT *, regexp_extract_all(wkt, '\\(([^()]+)\\)', 1) AS rings FROM {source}) q1) q2"""),
        (f"{prefix}_corners", f"""SELECT LOCATIONID, LOCATIONNAME, ring_no, i,
            CAST(string_split(trim(pts[i]), ' ')[1] AS DOUBLE) AS x,
            CAST(string_split(trim(pts[i]), ' ')[2] AS DOUBLE) AS y
          FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM (
            SELECT *, string_split(ring, ',') AS pts FROM {prefix}_rings) q1) q2"""),
        (f"{prefix}_edges", f"""SELECT a.LOCATIONID, a.LOCATIONNAME, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
          FROM {prefix}_corners a JOIN {prefix}_corners b ON a.LOCATIONID = b.LOCATIONID
            AND a.ring_no = b.ring_no AND b.i = a.i + 1"""),
    ]


_CROSS = "((x2 - x1) * (latitude - y1)) - ((longitude - x1) * (y2 - y1))"


def _bound(col: str, q: float) -> str:
    return (f"(SELECT {col} FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS r, "
            f"count(*) OVER () AS n FROM valid) q WHERE r = floor((n - 1) * CAST({q} AS DOUBLE) + 0.5))")


PIPELINE: list[tuple[str, str]] = [
    ("raw", _RAW),
    ("prepared", f"""SELECT *, 2018 - construction_year AS property_age, CAST(NULL AS DOUBLE) AS cnn_condition_score
        FROM (SELECT {_RENAMES}, LISTING_SEQ,
          CASE WHEN CONSTRUCTIONYEAR BETWEEN 1900 AND 2018 THEN CONSTRUCTIONYEAR END AS construction_year,
          CASE WHEN BUILTTYPEID_1 = 1 THEN 'new' WHEN BUILTTYPEID_2 = 1 THEN 'needs_renovation' ELSE 'good' END AS condition,
          CASE WHEN ISSTUDIO = 1 THEN 'studio' WHEN ISDUPLEX = 1 THEN 'duplex' ELSE 'flat' END AS property_type
        FROM raw) p"""),
    ("deduped", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id
        ORDER BY period DESC, LISTING_SEQ DESC) AS rn FROM prepared) q WHERE rn = 1"""),
    ("valid", f"""SELECT * FROM deduped WHERE price > 0 AND area_m2 > 0 AND unit_price_m2 > 0
        AND latitude BETWEEN {_B['lat_min']}::DOUBLE AND {_B['lat_max']}::DOUBLE
        AND longitude BETWEEN {_B['lon_min']}::DOUBLE AND {_B['lon_max']}::DOUBLE"""),
    ("bounds", "SELECT " + ", ".join(
        f"{_bound(c, q)} AS {c}_{s}" for c in C.OUTLIER_COLUMNS
        for s, q in (("low", C.OUTLIER_LOW), ("high", C.OUTLIER_HIGH)))),
    ("trimmed", "SELECT valid.* FROM valid, bounds WHERE " + " AND ".join(
        f"{c} BETWEEN {c}_low AND {c}_high" for c in C.OUTLIER_COLUMNS)),
    ("zones", src.ZONES_SQL.format(nation="nation")),
    *_edges("zones", "zone"),
    ("zone_hits", f"""SELECT asset_id, min(LOCATIONID) AS zone_id FROM (
        SELECT asset_id, LOCATIONID FROM trimmed, zone_edges GROUP BY asset_id, LOCATIONID
        HAVING sum(CASE WHEN (y1 <= latitude AND y2 > latitude AND {_CROSS} > 0)
                          OR (y2 <= latitude AND y1 > latitude AND {_CROSS} < 0) THEN 1 ELSE 0 END) % 2 = 1
           AND sum(CASE WHEN {_CROSS} = 0 AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2)
                         AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0) q
        GROUP BY asset_id"""),
    ("listings", "SELECT " + ", ".join(
        {"neighborhood_id": "z.LOCATIONID AS neighborhood_id",
         "neighborhood_name": "z.LOCATIONNAME AS neighborhood_name"}.get(
            n, f"CAST(t.{n} AS {'BIGINT' if C.TYPES[n] == C.INT else 'DOUBLE' if C.TYPES[n] == C.DBL else 'VARCHAR'}) AS {n}")
        for n in C.NAMES) + """ FROM trimmed t LEFT JOIN zone_hits h ON t.asset_id = h.asset_id
        LEFT JOIN zones z ON z.LOCATIONID = h.zone_id"""),
]


def hash_sql(key: str, seed: int) -> str:
    return f"CAST(('0x' || substr(md5(concat({key}, ':{seed}')), 1, 8)) AS BIGINT)"


# 64/16/20 split by hash order
SPLIT: list[tuple[str, str]] = [
    ("split_ranked", f"""SELECT asset_id, row_number() OVER (ORDER BY {hash_sql('asset_id', 42)}, asset_id) - 1 AS r,
        count(*) OVER () AS n FROM listings"""),
    ("split", """SELECT asset_id, CASE WHEN r < n_test THEN 'test' WHEN r < n_test + n_val THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, CAST(ceil((n - n_test) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_val FROM (
          SELECT *, CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_test FROM split_ranked) q1) q2"""),
]


def ctes(parts: list[tuple[str, str]]) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts)


def on_pipeline(sql: str, upto: str = "listings", extra: list[tuple[str, str]] = ()) -> str:
    """``sql`` over the pipeline's tables up to and including ``upto``, plus ``extra``."""
    names = [n for n, _ in PIPELINE]
    return ctes(PIPELINE[:names.index(upto) + 1] + list(extra)) + "\n" + sql


def on_listings(sql: str, *extra: tuple[str, str]) -> str:
    return on_pipeline(sql, "listings", list(extra))


def on_split(sql: str, *extra: tuple[str, str]) -> str:
    return on_pipeline(sql, "listings", [*SPLIT, *extra])


def parcel_edges(sql: str) -> str:
    return ctes([("parcels", src.PARCELS_SQL.format(customer="customer")),
                 *_edges("parcels", "parcel")]) + "\n" + sql


MEDIAN = "quantile_cont({}, 0.5)".format


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"
