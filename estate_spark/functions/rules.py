"""Row rules: years, energy band, form checks, defaults, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
VALID_YEAR_MIN, VALID_YEAR_MAX = 1800, 2018
OLD_YEAR_MAX, MID_YEAR_MIN, NEW_YEAR_MIN = 1979, 1980, 2007
FORM_RULES = [
    ("area_m2", 15, 1000, False, "Area must be a number between 15 and 1000 m2."),
    ("rooms", 0, 15, True, "Rooms must be a whole number between 0 and 15."),
    ("bathrooms", 0, 10, True, "Bathrooms must be a whole number between 0 and 10."),
    ("floor", -1, 30, False, "Floor must be a number between -1 and 30."),
    ("construction_year", 1850, 2018, True,
     "Construction year must be a whole number between 1850 and 2018 (the dataset year)."),
]
NO_LOCATION = "Click the map to set the property location."


def _ok_year(col: str) -> Column:
    return F.col(col).between(VALID_YEAR_MIN, VALID_YEAR_MAX)


def effective_year() -> Column:
    """First of (construction, cadastral) year that is itself in range."""
    return F.coalesce(F.when(_ok_year("construction_year"), F.col("construction_year")),
                      F.when(_ok_year("cad_construction_year"), F.col("cad_construction_year")))


def year_source() -> Column:
    return (F.when(_ok_year("construction_year"), "construction_year")
            .when(_ok_year("cad_construction_year"), "cad_construction_year"))


def coalesced_year() -> Column:
    """First non-null year; the range filter comes after, so an out-of-range first year
    hides a valid second one."""
    return F.coalesce("construction_year", "cad_construction_year")


def with_coalesced_year(df: DataFrame) -> DataFrame:
    return (df.withColumn("year", coalesced_year())
            .filter(F.col("year").between(VALID_YEAR_MIN, VALID_YEAR_MAX)))


def with_energy_band(df: DataFrame) -> DataFrame:
    """band, flag, effective_year, year_source."""
    year, new = F.col("effective_year"), F.col("condition") == "new"
    out = df.withColumn("effective_year", effective_year()).withColumn("year_source", year_source())
    return (out
            .withColumn("band", F.when(new, "C").when(year.isNull(), "unknown")
                        .when(year >= NEW_YEAR_MIN, "C").when(year >= MID_YEAR_MIN, "E").otherwise("F"))
            .withColumn("flag", F.col("band") == "F")
            .withColumn("year_source", F.when(new, F.coalesce("year_source", F.lit("condition")))
                        .otherwise(F.col("year_source"))))


def form_error() -> Column:
    """Message of the first rule an entered row breaks, null when it breaks none."""
    checks = []
    for col, low, high, whole, message in FORM_RULES:
        v = F.col(col).cast("double")
        ok = v.between(low, high) & ~F.isnan(v)
        if whole:
            ok = ok & (v == F.floor(v))
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), message))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return F.coalesce(*checks, F.when(~located, NO_LOCATION))


def align(df: DataFrame, features: list[str], types: dict[str, T.DataType],
          keep: list[str] = ()) -> DataFrame:
    """Exactly ``keep`` + ``features`` in order: missing ones null, extra ones dropped."""
    return df.select(*keep, *[
        (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
        for c in features])


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
