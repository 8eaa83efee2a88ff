"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, directory: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """A Parquet table of the folder; only ``columns`` reach the scan when given."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a declared schema: no inference pass; an empty field is null and a
    malformed line is kept in the corrupt-record column."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(full)
            .option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("enforceSchema", True).csv(path))


def export_csv(df: DataFrame, path: str, caveat: str) -> str:
    """Distributed CSV export; the caveat line goes to a side file, since a comment
    line in every part would break the headers."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
    note = df.sparkSession.range(1).select(F.concat(F.lit("# "), F.lit(caveat)).alias("value"))
    note.coalesce(1).write.mode("overwrite").text(f"{path}.caveat")
    return path


_RING = r"\(([^()]+)\)"


def parse_wkt(wkt: Column) -> Column:
    """(MULTI)POLYGON text -> array of directed edges of every ring, holes included."""
    # a value that is used twice is the element of a transform, so it is made once
    rings = F.regexp_extract_all(wkt, F.lit(_RING), F.lit(1))

    def corners(ring: Column) -> Column:
        pairs = F.transform(F.split(ring, ","), lambda text: F.split(F.trim(text), r"\s+"))
        return F.transform(pairs, lambda xy: F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y")))

    def ring_edges(pts: Column) -> Column:
        return F.zip_with(
            F.slice(pts, F.lit(1), F.size(pts) - 1), F.slice(pts, F.lit(2), F.size(pts) - 1),
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                                  b["x"].alias("x2"), b["y"].alias("y2")))

    return F.flatten(F.transform(F.transform(rings, corners), ring_edges))


def load_zones(df: DataFrame, wkt_col: str = "wkt") -> DataFrame:
    """Add the edge array and the bounding box of each zone."""
    out = df.withColumn("edges", parse_wkt(F.col(wkt_col)))
    xs = F.transform("edges", lambda e: e["x1"])
    ys = F.transform("edges", lambda e: e["y1"])
    return (out.withColumn("x_min", F.array_min(xs)).withColumn("x_max", F.array_max(xs))
            .withColumn("y_min", F.array_min(ys)).withColumn("y_max", F.array_max(ys)))
