"""Lookups by key, tables of keys, run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lookup(df: DataFrame, keys: DataFrame, key: str = "asset_id") -> DataFrame:
    """One row per requested key: the row's columns, ``found`` and, when the key is
    unknown, an error text and no other value."""
    hits = df.withColumn("found", F.lit(True))
    out = keys.select(key).distinct().join(hits, key, "left")
    return (out.withColumn("found", F.coalesce("found", F.lit(False)))
            .withColumn("error", F.when(~F.col("found"), F.concat(
                F.lit(f"{key} "), F.col(key), F.lit(" not found in listings")))))


def semi_lookup(df: DataFrame, ids: DataFrame, cols: list[str], key: str = "asset_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi").select(*cols)


def left_outside(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def guarded_join(left: DataFrame, right: DataFrame, on: str | list[str],
                 how: str = "inner") -> DataFrame:
    """Equi-join that refuses non-key columns present on both sides."""
    keys = [on] if isinstance(on, str) else list(on)
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides of the join: {clash}")
    return left.join(right, keys, how)


def join_keeping_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join in which every left row has exactly one partner; fails at run time otherwise.

    The right side is counted per key; the check is a row filter, which neither column
    pruning nor a bare count can remove.
    """
    rest = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.count("*").alias("_hits"), F.first(F.struct(F.lit(0), *rest)).alias("_right"))
    guarded_join(left.select(*left.columns), right, key)          # refuses clashing columns
    text = F.concat(F.when(F.col("_hits") > 1, F.concat(F.col("_hits").cast("string"), F.lit(" partners"))).otherwise("no partner"),
                    F.lit(f" for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("_hits") == 1, True).otherwise(F.raise_error(text).cast("boolean"))
    return left.join(one, key, "left").filter(checked).select(*left.columns, *[F.col("_right")[c].alias(c) for c in rest])


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("run_name", T.StringType()),
    T.StructField("start_time", T.TimestampType()), T.StructField("is_production", T.BooleanType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()))])


def production_run(runs: DataFrame, by: list[str] = ()) -> DataFrame:
    """The latest run tagged production (per ``by``), ties by run id."""
    rest = [c for c in runs.columns if c not in by]
    picked = runs.filter("is_production").groupBy(*by).agg(F.max_by(
        F.struct(*rest), F.struct("start_time", "run_id")).alias("_run"))
    return picked.filter(F.col("_run").isNotNull()).select(*by, "_run.*")
