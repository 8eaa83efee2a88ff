"""Data checks: null rates, profiles, expectations, split and comparables checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark import contract as C

SAMPLE_QUANTILES = [("cheap", 0.10), ("mid", 0.50), ("expensive", 0.90)]  # fixed values


def _as_rows(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def null_rates(df: DataFrame) -> DataFrame:
    """column_name, nulls, null_rate for every column in one pass."""
    cols = df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    return _as_rows(one, [F.struct(
        F.lit(c).alias("column_name"), (F.col("_n") - F.col(c)).alias("nulls"),
        F.try_divide(F.col("_n") - F.col(c), F.col("_n")).alias("null_rate")) for c in cols])


def value_profile(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """min/max of numeric columns, sorted value set of (few-valued) categorical ones."""
    aggs = [f(c).cast("double").alias(f"{p}_{c}") for c in numeric for p, f in (("min", F.min), ("max", F.max))]
    aggs += [F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(f"set_{c}")
             for c in categorical]
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    return _as_rows(df.agg(*aggs), [F.struct(
        F.lit(c).alias("column_name"), F.col(f"min_{c}").alias("min_value"),
        F.col(f"max_{c}").alias("max_value"), null_s.alias("value_set")) for c in numeric] + [F.struct(
            F.lit(c).alias("column_name"), null_d.alias("min_value"), null_d.alias("max_value"),
            F.col(f"set_{c}").alias("value_set")) for c in categorical])


def check(df: DataFrame, row_bounds: tuple[int, int], year_null_max: float = 0.7,
          match_min: float = 0.98) -> DataFrame:
    """rule, observed, ok: the twelve listing checks from one aggregate pass (plus the
    distinct id count, which combines map-side)."""
    b, n = C.BBOX, F.col("n")
    nulls = [*C.KEY_COLUMNS, "neighborhood_id", "neighborhood_name", "cnn_condition_score", "construction_year"]
    odd = ~(F.col("condition").isin(C.CONDITIONS) & F.col("property_type").isin(C.PROPERTY_TYPES)
            & F.col("period").isin(C.PERIODS))
    ranges = ["price", "area_m2", "unit_price_m2", "latitude", "longitude", "rooms", "bathrooms", "construction_year"]
    one = df.agg(
        F.count("*").alias("n"), F.count_distinct("asset_id").alias("ids"), F.count_if(odd).alias("odd"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in nulls],
        *[f(c).alias(f"{p}_{c}") for c in ranges for p, f in (("min", F.min), ("max", F.max))])
    keys_null = reduce(lambda x, y: x + y, [F.col(f"null_{c}") for c in C.KEY_COLUMNS])
    year_rate = F.try_divide(F.col("null_construction_year"), n)
    match_rate = F.try_divide(n - F.col("null_neighborhood_id"), n)
    smallest = F.least("min_price", "min_area_m2", "min_unit_price_m2")
    fewest = F.least("min_rooms", "min_bathrooms")
    rules = [
        ("columns_match_contract", F.lit(len(df.columns)), F.lit(df.columns == C.NAMES)),
        ("row_count_in_bounds", n, n.between(*row_bounds)),
        ("unique_id", n - F.col("ids"), n == F.col("ids")),
        ("key_columns_not_null", keys_null, keys_null == 0),
        ("year_null_rate", year_rate, year_rate < year_null_max),
        ("placeholder_all_null", n - F.col("null_cnn_condition_score"), F.col("null_cnn_condition_score") == n),
        ("zone_match_rate", match_rate, (match_rate >= match_min)
         & (F.col("null_neighborhood_id") == F.col("null_neighborhood_name"))),
        ("positive_price_area", smallest, smallest > 0),
        ("inside_bbox", F.lit(None), (F.col("min_latitude") >= b["lat_min"]) & (F.col("max_latitude") <= b["lat_max"])
         & (F.col("min_longitude") >= b["lon_min"]) & (F.col("max_longitude") <= b["lon_max"])),
        ("counts_not_negative", fewest, fewest >= 0),
        ("allowed_values", F.col("odd"), F.col("odd") == 0),
        ("year_range", F.lit(None), (F.col("min_construction_year") >= C.YEAR_MIN)
         & (F.col("max_construction_year") <= C.YEAR_MAX)),
    ]
    return _as_rows(one, [F.struct(F.lit(r).alias("rule"), o.cast("double").alias("observed"), F.coalesce(ok, F.lit(False)).alias("ok"))
                          for r, o, ok in rules])


def check_split(split: DataFrame, listings: DataFrame, test_share: float = 0.20,
                tolerance: float = 0.01) -> DataFrame:
    """rule, observed, ok: splits disjoint, every listing assigned and nothing else, and
    the test share. One full outer join of ids answers all three."""
    ids = split.groupBy("asset_id").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("copies"),
                                        F.max(F.when(F.col("split") == "test", 1)).alias("is_test"))
    both = ids.withColumn("_a", F.lit(1)).join(
        listings.select("asset_id").withColumn("_b", F.lit(1)), "asset_id", "full")
    one = both.agg(
        F.count_if(F.col("splits") > 1).alias("overlap"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("copies") > 1)).alias("gaps"),
        F.try_divide(F.count("is_test"), F.count("_a")).alias("share"))
    return _as_rows(one, [
        F.struct(F.lit("splits_disjoint").alias("rule"), F.col("overlap").cast("double").alias("observed"),
                 (F.col("overlap") == 0).alias("ok")),
        F.struct(F.lit("splits_cover_all").alias("rule"), F.col("gaps").cast("double").alias("observed"),
                 (F.col("gaps") == 0).alias("ok")),
        F.struct(F.lit("test_share").alias("rule"), F.col("share").alias("observed"),
                 F.coalesce(F.abs(F.col("share") - test_share) < tolerance, F.lit(False)).alias("ok"))])


def check_comps(comps: DataFrame, listings: DataFrame) -> DataFrame:
    """Per subject: every comparable exists once, at the same price, of the subject's type,
    and is not the subject."""
    real = listings.groupBy("asset_id").agg(
        F.count("*").alias("_copies"), F.min("price").alias("_price"), F.min("property_type").alias("_type"))
    mine = real.select(F.col("asset_id").alias("subject_id"), F.col("_type").alias("_subject_type"))
    return (comps.join(real, "asset_id", "left").join(mine, "subject_id", "left")
            .groupBy("subject_id").agg(
                F.bool_and(F.coalesce(F.col("_copies") == 1, F.lit(False))).alias("exist_once"),
                F.bool_and(F.coalesce(F.col("price") == F.col("_price"), F.lit(False))).alias("same_price"),
                F.bool_and(F.coalesce(F.col("_type") == F.col("_subject_type"), F.lit(False))).alias("same_type"),
                F.bool_and(F.col("asset_id") != F.col("subject_id")).alias("not_self"),
                F.count("*").alias("n")))
