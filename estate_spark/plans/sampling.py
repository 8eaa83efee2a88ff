"""Splits, tiles and samples as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.operators import curate, explore, lookup, quality, ranks, sampling, tiles
from estate_spark.plans.base_sql import hash_sql, on_listings, on_split
from estate_spark.plans.registry import query
from estate_spark.session import once, written
from estate_spark.sources import io

N_TRAIN, N_EVAL = tiles.TRAIN_TILES, tiles.EVAL_TILES


def split(spark, sf):
    """The stored split assignment."""
    return once(spark, ("split", sf), lambda: written(sampling.split_3way(curate.curated(spark, sf)), "split"))


def assigned(spark, sf):
    return once(spark, ("tiles", sf), lambda: written(
        tiles.assignment(curate.curated(spark, sf), split(spark, sf)), "tiles"))


def _txt(c: str) -> str:
    return f"printf('%.4f', {c})"


_ROUND = "floor({0} * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE".format
TILED = ("tiled", f"""SELECT *, concat({_txt('tile_lat')}, '_', {_txt('tile_lon')}) AS tile_id FROM (
    SELECT l.asset_id, latitude, longitude, condition, split, {_ROUND('latitude')} AS tile_lat, {_ROUND('longitude')} AS tile_lon,
      CASE WHEN condition IN ('good', 'new') THEN 1 ELSE 0 END AS label
    FROM listings l JOIN split s ON s.asset_id = l.asset_id) q""")
PURITY = ("purity", """SELECT tile_id, bool_or(split <> 'train') AS has_val_or_test, count(*) AS n_listings,
    NOT bool_or(split <> 'train') AS cnn_trainable FROM tiled GROUP BY tile_id""")
ASSIGNED = ("assigned", "SELECT t.*, has_val_or_test, n_listings, cnn_trainable FROM tiled t JOIN purity p ON p.tile_id = t.tile_id")
LABELS = [(f"{role}_tiles", f"""SELECT tile_id, min(tile_lat) AS tile_lat, min(tile_lon) AS tile_lon,
    CASE WHEN avg(label) >= 0.5 THEN 1 ELSE 0 END AS tile_label FROM assigned WHERE {cond} GROUP BY tile_id""")
    for role, cond in (("train", "cnn_trainable AND split = 'train'"), ("eval", "split = 'val'"))]


def _sample(role: str, n: int) -> tuple[str, str]:
    h = hash_sql("tile_id", 42)
    return (f"{role}_sample", f"""SELECT tile_id, tile_lat, tile_lon, tile_label, '{role}' AS role FROM (
      SELECT *, row_number() OVER (ORDER BY {h}, tile_id) AS pos FROM (
        SELECT *, row_number() OVER (PARTITION BY tile_label ORDER BY {h}, tile_id) - 1 AS r,
          count(*) OVER (PARTITION BY tile_label) AS nc, count(*) OVER () AS nt FROM {role}_tiles) q1
      WHERE r < ceil(CAST(nc AS DOUBLE) / nt * CAST({n} AS DOUBLE))) q2 WHERE pos <= {n}""")


MANIFEST = [TILED, PURITY, ASSIGNED, *LABELS, _sample("train", N_TRAIN), _sample("eval", N_EVAL),
            ("manifest", "SELECT * FROM train_sample UNION ALL SELECT * FROM eval_sample")]


def manifest(spark, sf):
    return tiles.manifest(assigned(spark, sf), N_TRAIN, N_EVAL)


@query("split_3way", on_split("SELECT asset_id, split FROM split"))
def split_3way(spark, sf):
    return sampling.split_3way(curate.curated(spark, sf))


@query("split_persist", on_split("SELECT split, count(*) AS n FROM split GROUP BY 1"))
def split_persist(spark, sf):
    return split(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query("split_checks", on_split("""SELECT rule, observed, ok FROM (
    SELECT count(*) AS n, count(*) FILTER (WHERE split = 'test') AS t FROM split) q,
    LATERAL (VALUES ('splits_disjoint', 0::DOUBLE, true), ('splits_cover_all', 0::DOUBLE, true),
      ('test_share', round(t / CAST(n AS DOUBLE), 6), abs(t / CAST(n AS DOUBLE) - 0.2) < 0.01)) AS v(rule, observed, ok)"""))
def split_checks(spark, sf):
    return quality.check_split(split(spark, sf), curate.curated(spark, sf)).withColumn("observed", F.round("observed", 6))


@query("sample_fraction", on_listings(f"SELECT asset_id, price FROM listings WHERE {hash_sql('asset_id', 42)} < {int(0.25 * 2**32)}"))
def sample_fraction(spark, sf):
    return sampling.hash_sample(curate.curated(spark, sf), "asset_id", 0.25).select("asset_id", "price")


@query("join_split", on_split("""SELECT l.asset_id, split, price FROM listings l JOIN split s ON s.asset_id = l.asset_id
    WHERE split IN ('train', 'val')"""))
def join_split(spark, sf):
    df = curate.curated(spark, sf).select("asset_id", "price")
    return lookup.guarded_join(df, split(spark, sf).filter(F.col("split").isin("train", "val")), "asset_id")


@query("join_rowcount_guard", on_split("SELECT l.asset_id, split, condition FROM listings l JOIN split s ON s.asset_id = l.asset_id"))
def join_rowcount_guard(spark, sf):
    return lookup.join_keeping_all(curate.curated(spark, sf).select("asset_id", "condition"), split(spark, sf), "asset_id")


@query("join_collision_guard", on_split("""SELECT count(*) AS scored, count(*) AS n, true AS refused_collision
    FROM assigned a JOIN manifest m ON m.tile_id = a.tile_id""", *MANIFEST))
def join_collision_guard(spark, sf):
    """The placeholder must go before a score of the same name can be joined."""
    listings, scores = curate.curated(spark, sf), tile_scores(spark, sf)
    tagged = listings.join(assigned(spark, sf).select("asset_id", "tile_id"), "asset_id")
    try:
        lookup.guarded_join(tagged, scores, "tile_id")
        refused = False
    except ValueError:
        refused = True
    ok = lookup.guarded_join(tagged.drop("cnn_condition_score"), scores, "tile_id")
    return ok.agg(F.count("cnn_condition_score").alias("scored"), F.count("*").alias("n")).withColumn(
        "refused_collision", F.lit(refused))


def tile_scores(spark, sf):
    """A deterministic stand-in for a tile score in [0, 1)."""
    return manifest(spark, sf).select("tile_id", (ranks.seeded_hash("tile_id", 7) / F.lit(float(2 ** 32))).alias(
        "cnn_condition_score"))


_SCORE = f"CAST({hash_sql('tile_id', 7)} AS DOUBLE) / CAST(4294967296 AS DOUBLE)"


@query("join_score_attach", on_split(f"""SELECT a.asset_id, a.tile_id, a.split, role, {_SCORE.replace('tile_id', 'm.tile_id')} AS cnn_condition_score
    FROM assigned a JOIN manifest m ON m.tile_id = a.tile_id""", *MANIFEST))
def join_score_attach(spark, sf):
    m = manifest(spark, sf).select("tile_id", "role")
    scores = lookup.guarded_join(m, tile_scores(spark, sf), "tile_id")
    return lookup.guarded_join(assigned(spark, sf).select("asset_id", "tile_id", "split"), scores, "tile_id").select(
        "asset_id", "tile_id", "split", "role", "cnn_condition_score")


@query("tile_id", on_split("SELECT asset_id, tile_lat, tile_lon, tile_id FROM tiled", TILED))
def tile_id(spark, sf):
    return tiles.with_tile(curate.curated(spark, sf)).select("asset_id", "tile_lat", "tile_lon", "tile_id")


@query("binary_label", on_listings("""SELECT asset_id, CASE WHEN condition IN ('good', 'new') THEN 1 ELSE 0 END AS label FROM listings"""))
def binary_label(spark, sf):
    return tiles.with_tile(curate.curated(spark, sf)).select("asset_id", "label")


_BBOX = ", '%2C', ".join(f"printf('%.6f', {c})" for c in (
    "tile_lat - 0.00054::DOUBLE", "tile_lon - 0.00071::DOUBLE", "tile_lat + 0.00054::DOUBLE", "tile_lon + 0.00071::DOUBLE"))


@query("tile_bbox_url", on_split(f"""SELECT DISTINCT tile_id, concat('{tiles.WMS_URL}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS=OI.OrthoimageCoverage&STYLES=&CRS=EPSG%3A4326&BBOX=',
    {_BBOX}, '&WIDTH=256&HEIGHT=256&FORMAT=image%2Fjpeg') AS url FROM tiled""", TILED))
def tile_bbox_url(spark, sf):
    t = tiles.with_tile(curate.curated(spark, sf)).select("tile_id", "tile_lat", "tile_lon").distinct()
    return t.select("tile_id", tiles.tile_url(F.col("tile_lat"), F.col("tile_lon")).alias("url"))


@query("tile_purity", on_split("SELECT * FROM purity", TILED, PURITY))
def tile_purity(spark, sf):
    rows = tiles.with_tile(lookup.guarded_join(
        curate.curated(spark, sf).select("asset_id", "latitude", "longitude", "condition"), split(spark, sf), "asset_id"))
    return tiles.purity(rows)


@query("join_left_attach", on_split("""SELECT asset_id, split, tile_id, label, has_val_or_test, n_listings, cnn_trainable
    FROM assigned""", TILED, PURITY, ASSIGNED))
def join_left_attach(spark, sf):
    return tiles.assignment(curate.curated(spark, sf), split(spark, sf)).select(
        "asset_id", "split", "tile_id", "label", "has_val_or_test", "n_listings", "cnn_trainable")


@query("tile_label", on_split("SELECT 'train' AS role, * FROM train_tiles UNION ALL SELECT 'eval', * FROM eval_tiles", *MANIFEST))
def tile_label(spark, sf):
    a = assigned(spark, sf)
    train = tiles.tile_labels(a.filter("cnn_trainable and split = 'train'")).withColumn("role", F.lit("train"))
    return train.unionByName(tiles.tile_labels(a.filter("split = 'val'")).withColumn("role", F.lit("eval")))


@query("distinct_counts", on_split("""SELECT count(DISTINCT tile_id) AS tiles, count(DISTINCT tile_id) FILTER (WHERE cnn_trainable) AS pure_tiles,
    count(DISTINCT tile_id) - count(DISTINCT tile_id) FILTER (WHERE cnn_trainable) AS mixed_tiles,
    count(*) FILTER (WHERE has_val_or_test AND split = 'train') AS straddling_rows FROM assigned""", TILED, PURITY, ASSIGNED))
def distinct_counts(spark, sf):
    return tiles.purity_summary(assigned(spark, sf))


@query("straddle_exclusion", on_split("SELECT asset_id, tile_id FROM assigned WHERE has_val_or_test AND split = 'train'",
                                      TILED, PURITY, ASSIGNED))
def straddle_exclusion(spark, sf):
    return tiles.straddle_filter(assigned(spark, sf)).select("asset_id", "tile_id")


@query("stratified_sample", on_split("SELECT * FROM train_sample", *MANIFEST))
def stratified_sample(spark, sf):
    t = tiles.tile_labels(assigned(spark, sf).filter("cnn_trainable and split = 'train'"))
    return sampling.stratified_sample(t, "tile_id", "tile_label", N_TRAIN).withColumn("role", F.lit("train"))


@query("union_roles", on_split("SELECT * FROM manifest", *MANIFEST))
def union_roles(spark, sf):
    return manifest(spark, sf)


@query("group_counts", on_split("""SELECT role, CAST(tile_label AS VARCHAR) AS class, count(*) AS n FROM manifest GROUP BY 1, 2
    UNION ALL SELECT split, 'all', count(*) FROM split GROUP BY 1""", *MANIFEST))
def group_counts(spark, sf):
    a = explore.counts(manifest(spark, sf), ["role", "tile_label"]).select(
        "role", F.col("tile_label").cast("string").alias("class"), "n")
    b = explore.counts(split(spark, sf), ["split"]).select(F.col("split").alias("role"), F.lit("all").alias("class"), "n")
    return a.unionByName(b)


@query("overlap_check", on_split("""SELECT count(*) AS overlap FROM (SELECT tile_id FROM train_sample INTERSECT SELECT tile_id FROM eval_tiles) q""",
                                 *MANIFEST))
def overlap_check(spark, sf):
    a = assigned(spark, sf)
    train = manifest(spark, sf).filter("role = 'train'")
    return tiles.overlap_count(train, a.filter("split = 'val'"), "tile_id")


@query("coverage_check", on_split("""SELECT (SELECT count(*) FROM (SELECT asset_id FROM listings EXCEPT SELECT asset_id FROM split) a) AS unassigned,
    (SELECT count(*) FROM (SELECT asset_id FROM split EXCEPT SELECT asset_id FROM listings) b) AS unknown"""))
def coverage_check(spark, sf):
    a, b = curate.curated(spark, sf).select("asset_id"), split(spark, sf).select("asset_id")
    left = a.exceptAll(b).agg(F.count("*").alias("unassigned"))
    return left.withColumn("unknown", b.exceptAll(a).agg(F.count("*")).scalar())


@query("semi_in", on_split("SELECT asset_id, tile_id FROM assigned WHERE tile_id IN (SELECT tile_id FROM manifest)", *MANIFEST))
def semi_in(spark, sf):
    return lookup.semi_lookup(assigned(spark, sf), manifest(spark, sf), ["asset_id", "tile_id"], "tile_id")


@query("anti_in", on_split("SELECT asset_id, tile_id FROM assigned WHERE tile_id NOT IN (SELECT tile_id FROM manifest)", *MANIFEST))
def anti_in(spark, sf):
    return lookup.left_outside(assigned(spark, sf).select("asset_id", "tile_id"), manifest(spark, sf), "tile_id")


@query("kfold_assign", on_split(f"""SELECT tile_id, CAST({hash_sql('tile_id', 42)} % 5 AS INTEGER) AS fold FROM train_sample""", *MANIFEST))
def kfold_assign(spark, sf):
    return manifest(spark, sf).filter("role = 'train'").select("tile_id", sampling.fold_of("tile_id").alias("fold"))


@query("group_holdout", on_split(f"""SELECT asset_id, tile_id, {hash_sql('tile_id', 42)} < {int(0.1 * 2**32)} AS is_stop
    FROM assigned WHERE split = 'train'""", TILED, PURITY, ASSIGNED))
def group_holdout(spark, sf):
    return assigned(spark, sf).filter("split = 'train'").select(
        "asset_id", "tile_id", sampling.held_out("tile_id").alias("is_stop"))


_VECTORS = "SELECT concat('V', CAST(vec_id AS VARCHAR(20))) AS row_id, embedding FROM {embeddings}"
_ROWS = """SELECT concat('V', CAST(vec_id AS VARCHAR(20))) AS row_id, label % 2 AS tile_label,
    CASE WHEN vec_id % 5 = 0 THEN 'eval' ELSE 'train' END AS role FROM {embeddings}"""


@query("align_matrix", """SELECT concat('V', CAST(vec_id AS VARCHAR(20))) AS row_id, label % 2 AS tile_label, len(embedding) AS width,
    CAST(embedding[1] AS DOUBLE) AS first_value FROM embeddings""")
def align_matrix(spark, sf):
    e = io.read_table(spark, sf, "embeddings")
    m = lookup.join_keeping_all(spark.sql(_ROWS, embeddings=e), spark.sql(_VECTORS, embeddings=e), "row_id")
    return m.select("row_id", "tile_label", F.size("embedding").cast("bigint").alias("width"),
                    F.col("embedding")[0].cast("double").alias("first_value"))


@query("available_only", """SELECT CASE WHEN vec_id % 5 = 0 THEN 'eval' ELSE 'train' END AS role,
    vec_id IN (SELECT doc_id FROM labels) AS has_file, count(*) AS n FROM embeddings GROUP BY 1, 2""")
def available_only(spark, sf):
    rows = io.read_table(spark, sf, "embeddings", ["vec_id"]).withColumn(
        "role", F.when(F.col("vec_id") % 5 == 0, "eval").otherwise("train"))
    have = io.read_table(spark, sf, "labels", ["doc_id"]).withColumnRenamed("doc_id", "vec_id")
    return explore.counts(tiles.available_only(rows, have, "vec_id"), ["role", "has_file"])


@query("extreme_rows", on_split("""SELECT which, asset_id, price, area_m2 FROM (
    SELECT 'lowest' AS which, l.asset_id, price, area_m2, row_number() OVER (ORDER BY price, l.asset_id) AS rn
    FROM listings l JOIN split s ON s.asset_id = l.asset_id WHERE split = 'test'
    UNION ALL SELECT 'highest', l.asset_id, price, area_m2, row_number() OVER (ORDER BY price DESC, l.asset_id)
    FROM listings l JOIN split s ON s.asset_id = l.asset_id WHERE split = 'test') q WHERE rn = 1"""))
def extreme_rows(spark, sf):
    test = curate.curated(spark, sf).join(split(spark, sf).filter("split = 'test'"), "asset_id", "left_semi")
    return explore.extremes(test, "price", "asset_id", ["price", "area_m2"])
