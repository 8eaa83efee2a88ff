"""The listings contract: column names, types, roles and cleaning constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
REFERENCE_YEAR = 2018
BBOX = {"lat_min": 40.30, "lat_max": 40.60, "lon_min": -3.90, "lon_max": -3.55}
OUTLIER_LOW, OUTLIER_HIGH = 0.01, 0.99
OUTLIER_COLUMNS = ["price", "area_m2", "unit_price_m2"]
YEAR_MIN, YEAR_MAX = 1900, 2018
PERIODS = [201803, 201806, 201809, 201812]
CONDITIONS = ["new", "needs_renovation", "good"]
PROPERTY_TYPES = ["studio", "duplex", "flat"]

# raw column -> contract column
COLUMN_MAP = {
    "ASSETID": "asset_id",
    "PERIOD": "period",
    "PRICE": "price",
    "UNITPRICE": "unit_price_m2",
    "CONSTRUCTEDAREA": "area_m2",
    "ROOMNUMBER": "rooms",
    "BATHNUMBER": "bathrooms",
    "FLOORCLEAN": "floor",
    "CONSTRUCTIONYEAR": "construction_year",
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "HASTERRACE": "has_terrace",
    "HASLIFT": "has_lift",
    "HASAIRCONDITIONING": "has_air_conditioning",
    "HASPARKINGSPACE": "has_parking",
    "ISPARKINGSPACEINCLUDEDINPRICE": "parking_included_in_price",
    "PARKINGSPACEPRICE": "parking_space_price",
    "HASNORTHORIENTATION": "has_north_orientation",
    "HASSOUTHORIENTATION": "has_south_orientation",
    "HASEASTORIENTATION": "has_east_orientation",
    "HASWESTORIENTATION": "has_west_orientation",
    "HASBOXROOM": "has_box_room",
    "HASWARDROBE": "has_wardrobe",
    "HASSWIMMINGPOOL": "has_swimming_pool",
    "HASDOORMAN": "has_doorman",
    "HASGARDEN": "has_garden",
    "ISDUPLEX": "is_duplex",
    "ISSTUDIO": "is_studio",
    "ISINTOPFLOOR": "is_top_floor",
    "AMENITYID": "amenity_id",
    "FLATLOCATIONID": "flat_location_id",
    "CADCONSTRUCTIONYEAR": "cad_construction_year",
    "CADMAXBUILDINGFLOOR": "cad_max_building_floor",
    "CADDWELLINGCOUNT": "cad_dwelling_count",
    "CADASTRALQUALITYID": "cadastral_quality_id",
    "DISTANCE_TO_CITY_CENTER": "distance_to_city_center",
    "DISTANCE_TO_METRO": "distance_to_metro",
    "DISTANCE_TO_CASTELLANA": "distance_to_castellana",
}
# --- end of fixed values ----------------------------------------------------

TARGET = "price"
LEAKAGE = ["unit_price_m2"]
IDENTIFIERS = ["asset_id", "period"]
DISPLAY_ONLY = ["neighborhood_name"]
PLACEHOLDERS = ["cnn_condition_score"]
CATEGORICAL = ["property_type", "condition", "neighborhood_id"]

STR, INT, DBL = T.StringType(), T.LongType(), T.DoubleType()


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    nullable: bool
    note: str


def _columns() -> list[Column]:
    raw_of = {v: k for k, v in COLUMN_MAP.items()}

    def col(name, dtype, nullable=False, note=None):
        return Column(name, dtype, nullable, note or f"copied from {raw_of[name]}")

    def flags(*names):
        return [col(n, INT, note=f"0/1 flag from {raw_of[n]}") for n in names]

    return [
        col("asset_id", STR),
        col("period", INT, note="snapshot key YYYYMM"),
        col("price", DBL, note="asking price, the model target"),
        col("unit_price_m2", DBL, note="price per m2, leaks the target"),
        col("area_m2", DBL),
        col("rooms", INT),
        col("bathrooms", INT),
        col("floor", INT, True),
        col("property_type", STR, note="derived from the studio and duplex flags"),
        col("condition", STR, note="derived from the one-hot build type"),
        col("construction_year", INT, True, "null outside the valid range"),
        col("property_age", INT, True, "reference year minus construction year"),
        col("latitude", DBL),
        col("longitude", DBL),
        col("neighborhood_id", STR, True, "zone holding the point"),
        col("neighborhood_name", STR, True, "name of that zone"),
        *flags("has_terrace", "has_lift", "has_air_conditioning", "has_parking",
               "parking_included_in_price"),
        col("parking_space_price", DBL),
        *flags("has_north_orientation", "has_south_orientation",
               "has_east_orientation", "has_west_orientation", "has_box_room",
               "has_wardrobe", "has_swimming_pool", "has_doorman", "has_garden",
               "is_duplex", "is_studio", "is_top_floor"),
        col("amenity_id", INT, True),
        col("flat_location_id", INT, True),
        col("cad_construction_year", INT, True),
        col("cad_max_building_floor", INT, True),
        col("cad_dwelling_count", INT, True),
        col("cadastral_quality_id", INT, True),
        col("distance_to_city_center", DBL),
        col("distance_to_metro", DBL),
        col("distance_to_castellana", DBL),
        col("cnn_condition_score", DBL, True, "placeholder, always null"),
    ]


COLUMNS = _columns()
NAMES = [c.name for c in COLUMNS]
TYPES = {c.name: c.type for c in COLUMNS}
KEY_COLUMNS = ["asset_id", "period", "price", "unit_price_m2", "area_m2", "rooms",
               "bathrooms", "property_type", "condition", "latitude", "longitude"]


def struct_type() -> T.StructType:
    """The contract as a Spark schema with the notes as column comments."""
    return T.StructType(
        [T.StructField(c.name, c.type, True, {"comment": c.note}) for c in COLUMNS]
    )


@dataclass(frozen=True)
class Roles:
    model: list[str]
    usable: list[str]
    categorical: list[str]
    numeric: list[str]


def feature_roles() -> Roles:
    """Model inputs = everything but target, leakage, identifiers and display columns."""
    barred = {TARGET, *LEAKAGE, *IDENTIFIERS, *DISPLAY_ONLY}
    model = [n for n in NAMES if n not in barred]
    usable = [n for n in model if n not in PLACEHOLDERS]
    return Roles(model, usable, list(CATEGORICAL),
                 [n for n in usable if n not in CATEGORICAL])


def assert_no_leakage(features: list[str]) -> None:
    leaked = sorted(set(features) & {TARGET, *LEAKAGE, *IDENTIFIERS})
    if leaked:
        raise ValueError(f"columns that must not be model inputs: {leaked}")


def project_contract(df: DataFrame) -> DataFrame:
    """Exact column set, order and types of the contract."""
    missing = [n for n in NAMES if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the contract: {missing}")
    return df.select(*[F.col(n).cast(TYPES[n]).alias(n) for n in NAMES])


def numeric_candidates() -> list[str]:
    """Numeric model inputs, before all-null columns are dropped."""
    return [n for n in feature_roles().model
            if n not in CATEGORICAL and TYPES[n] != STR]
