"""Image tiles: ids, labels, purity, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.functions.text import fixed
from estate_spark.operators import ranks, sampling
from estate_spark.operators.lookup import join_keeping_all

# fixed values
DECIMALS = 4
HALF_LAT, HALF_LON, TILE_PX = 0.00054, 0.00071, 256
POSITIVE = ["good", "new"]
TRAIN_TILES, EVAL_TILES = 16000, 4000
WMS_URL = "https://www.ign.es/wms-inspire/pnoa-ma"
WMS_QUERY = [("SERVICE", "WMS"), ("VERSION", "1.3.0"), ("REQUEST", "GetMap"),
             ("LAYERS", "OI.OrthoimageCoverage"), ("STYLES", ""), ("CRS", "EPSG:4326"), ("BBOX", None),
             ("WIDTH", str(TILE_PX)), ("HEIGHT", str(TILE_PX)), ("FORMAT", "image/jpeg")]



def with_tile(df: DataFrame) -> DataFrame:
    """tile_lat, tile_lon, tile_id, label (1 when the condition is a positive one)."""
    out = (df.withColumn("tile_lat", ranks.round_half_up(F.col("latitude"), DECIMALS))
           .withColumn("tile_lon", ranks.round_half_up(F.col("longitude"), DECIMALS)))
    return (out.withColumn("tile_id", F.concat(fixed(F.col("tile_lat"), DECIMALS), F.lit("_"),
                                               fixed(F.col("tile_lon"), DECIMALS)))
            .withColumn("label", F.col("condition").isin(POSITIVE).cast("int")))


def tile_url(lat: Column, lon: Column, base: str = WMS_URL) -> Column:
    corners = [lat - HALF_LAT, lon - HALF_LON, lat + HALF_LAT, lon + HALF_LON]
    bbox = F.concat_ws(",", *[fixed(c, 6) for c in corners])
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(bbox if v is None else F.lit(v))) for k, v in WMS_QUERY]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def purity(df: DataFrame) -> DataFrame:
    """Per tile: any row outside train, row count, trainable."""
    return (df.groupBy("tile_id").agg(F.bool_or(F.col("split") != "train").alias("has_val_or_test"),
                                      F.count("*").alias("n_listings"))
            .withColumn("cnn_trainable", ~F.col("has_val_or_test")))


def assignment(listings: DataFrame, split: DataFrame) -> DataFrame:
    """Listings with split, tile, label and their tile's purity; every listing must have a
    split. The per-tile table is joined back rather than windowed, so that a tile with very
    many listings is combined map-side and its rows stay spread out."""
    cols = listings.select("asset_id", "latitude", "longitude", "condition")
    tiled = with_tile(join_keeping_all(cols, split, "asset_id"))
    return tiled.join(purity(tiled), "tile_id", "left")


def straddle_filter(assigned: DataFrame) -> DataFrame:
    """Train rows whose tile also holds a row of another split: kept out of training."""
    return assigned.filter(F.col("has_val_or_test") & (F.col("split") == "train"))


def tile_labels(rows: DataFrame) -> DataFrame:
    """Per tile: its corner and the majority label, ties positive."""
    return rows.groupBy("tile_id").agg(
        F.min("tile_lat").alias("tile_lat"), F.min("tile_lon").alias("tile_lon"),
        (F.avg("label") >= 0.5).cast("int").alias("tile_label"))


def manifest(assigned: DataFrame, n_train: int = TRAIN_TILES, n_eval: int = EVAL_TILES,
             seed: int = sampling.SEED) -> DataFrame:
    """Sampled pure train tiles and val tiles with their role."""
    train = tile_labels(assigned.filter("cnn_trainable and split = 'train'"))
    ev = tile_labels(assigned.filter("split = 'val'"))
    return (sampling.stratified_sample(train, "tile_id", "tile_label", n_train, seed)
            .withColumn("role", F.lit("train"))
            .unionByName(sampling.stratified_sample(ev, "tile_id", "tile_label", n_eval, seed)
                         .withColumn("role", F.lit("eval"))))


def purity_summary(assigned: DataFrame) -> DataFrame:
    """tiles, pure, mixed, straddling train rows."""
    return assigned.agg(
        F.count_distinct("tile_id").alias("tiles"),
        F.count_distinct(F.when(F.col("cnn_trainable"), F.col("tile_id"))).alias("pure_tiles"),
        F.count_if(F.col("has_val_or_test") & (F.col("split") == "train")).alias("straddling_rows")
    ).select("tiles", "pure_tiles", (F.col("tiles") - F.col("pure_tiles")).alias("mixed_tiles"), "straddling_rows")


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("overlap"))


def available_only(manifest_df: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Manifest rows with ``has_file``: whether the inventory lists their artifact."""
    have = inventory.select(key).distinct().withColumn("_have", F.lit(True))
    return (manifest_df.join(have, key, "left")
            .withColumn("has_file", F.coalesce("_have", F.lit(False))).drop("_have"))
