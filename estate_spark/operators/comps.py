"""Exact top-k comparables for many subjects at once.

score = km + |area diff| / 20 + 0.7 |rooms diff|, over pool rows of the subject's type,
ties by asset id, never the subject itself. No pair outside a proven radius is formed:

1. Equal points: of pool rows with the same type, place, area and rooms only the k+1
   smallest ids can ever be an answer, so the others are dropped before anything is
   paired (the rank limit runs map-side); subjects are reduced to distinct points too.
   A hot spot of identical listings costs one point.
2. Bound: rows are ordered along shifted Z curves over (lat, lon, area). A subject meets
   its k+1 curve neighbours on both sides, by an equi-join on curve rank; the (k+1)-th
   best of them is an upper bound U of its k-th best score.
3. Search: all score terms are >= 0, so an answer lies within U km, 20 U m2 and U / 0.7
   rooms. Pool rows are keyed by grid cells at the cell sizes in use; a subject probes the
   cells of the size matching its U that can hold a score <= U, and keeps its top rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark.functions import geo
from estate_spark.functions.text import fixed
from estate_spark.operators import ranks
from estate_spark.session import grown, spread, written

TOP_K = 5                       # fixed value
FEW_SUBJECTS = 64
POINTS_PER_TASK = 5_000
KM_PER_DEG = 111.19             # a little under the true 6371 km sphere's 111.195
_SLACK = 1e-6                   # float error must not drop a true neighbour
_BITS = 14                      # per axis; 42 bits of curve position fit a double exactly
_MIN_LEVEL, _MAX_LEVEL = -12, 40
POINT = ["property_type", "latitude", "longitude", "area_m2", "rooms"]
S_POINT = [f"s_{c}" for c in POINT]


def _scored(df: DataFrame) -> DataFrame:
    """distance_km, area_diff_m2, rooms_diff, score between the s_ columns and the pool row."""
    out = df.withColumn("distance_km", geo.haversine_km(
        F.col("s_latitude"), F.col("s_longitude"), F.col("latitude"), F.col("longitude")))
    out = out.withColumn("area_diff_m2", F.abs(F.col("area_m2") - F.col("s_area_m2")))
    out = out.withColumn("rooms_diff", F.abs(F.col("rooms") - F.col("s_rooms")))
    return out.withColumn("score", geo.score(F.col("distance_km"), F.col("area_diff_m2"), F.col("rooms_diff")))


def _top(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("score", "asset_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _axes(lat: Column, lon: Column, area: Column, lon_scale: float) -> list[Column]:
    """Position in score units per axis."""
    return [lat * F.lit(KM_PER_DEG), lon * F.lit(lon_scale), area / F.lit(geo.AREA_SCALE_M2)]


def _frame(pool: DataFrame, points: DataFrame) -> tuple[float, dict]:
    """Smallest km per longitude degree over both sides, and each axis' 0.1%-99.9% pool
    range; one bounded row, fixed before use so that every stage cuts the axes alike.

    Data that spans more than half the globe gets scale 0, which leaves longitude out of
    the pruning (its two ends may be neighbours) but not out of the score.
    """
    row = pool.agg(F.max(F.abs("latitude")).alias("lat"), F.min("longitude").alias("w"), F.max("longitude").alias("e"), *[
        F.percentile_approx(c, [0.001, 0.999], 10000).alias(c) for c in ("latitude", "longitude", "area_m2")]).first()
    ask = points.agg(F.max(F.abs("s_latitude")).alias("lat"), F.min("s_longitude").alias("w"),
                     F.max("s_longitude").alias("e")).first()
    lat = max(row["lat"] or 0.0, ask["lat"] or 0.0)
    west = min(x for x in (row["w"], ask["w"], 0.0 if row["w"] is None else row["w"]) if x is not None)
    east = max(x for x in (row["e"], ask["e"], 0.0 if row["e"] is None else row["e"]) if x is not None)
    scale = KM_PER_DEG * max(math.cos(math.radians(min(lat, 90.0))), 0.0) if east - west <= 180 else 0.0
    return scale, {c: row[c] or [0.0, 1.0] for c in ("latitude", "longitude", "area_m2")}


def _on_curve(df: DataFrame, prefix: str, scale: float, spans: dict, shift: float) -> DataFrame:
    """Add ``value``: the position on a Z curve moved by ``shift`` of the range on each axis."""
    factor = {"latitude": KM_PER_DEG, "longitude": scale, "area_m2": 1 / geo.AREA_SCALE_M2}
    width = max(max((hi - lo) * factor[c] for c, (lo, hi) in spans.items()), 1e-9) * 1.5
    top = (1 << _BITS) - 1
    axes = _axes(*[F.col(f"{prefix}{c}") for c in spans], scale)
    cells = {}
    for i, (axis, c) in enumerate(zip(axes, spans)):
        unit = (axis - F.lit(spans[c][0] * factor[c])) / F.lit(width) + F.lit(shift)
        cells[f"_z{i}"] = F.least(F.greatest(F.floor(unit * F.lit(float(top))), F.lit(0)), F.lit(top)).cast("bigint")
    bits = [F.shiftleft(F.shiftright(F.col(f"_z{i}"), b).bitwiseAND(F.lit(1)), 3 * b + i)
            for b in range(_BITS) for i in range(3)]
    return (df.withColumns(cells).withColumn("value", reduce(Column.bitwiseOR, bits).cast("double"))
            .drop(*cells))


def _curve_candidates(points: DataFrame, pool: DataFrame, k: int, scale: float, spans: dict,
                      shift: float) -> DataFrame:
    """(subject point, pool row) for the k+1 curve neighbours before and after each subject."""
    rows = _on_curve(pool, "", scale, spans, shift).select(
        F.col("property_type").alias("series"), "value", F.struct("asset_id", *POINT[1:]).alias("row"))
    asks = _on_curve(points, "s_", scale, spans, shift).select(
        F.col("s_property_type").alias("series"), "value", F.struct(*S_POINT).alias("s"))
    marks = rows.unionByName(asks, allowMissingColumns=True)
    # edges from the pool side, so that every bucket holds its share of pool rows; a bucket's
    # offset makes ranks global per type, so neighbours are found across bucket borders
    edges = ranks.value_edges(rows.select("series", "value"))
    marks = ranks._with_bucket(marks, edges)
    before = Window.partitionBy("series").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marks.groupBy("series", "bucket").agg(F.count("row").alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    w = (Window.partitionBy("series", "bucket").orderBy("value", F.col("row.asset_id"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (marks.withColumn("_in", F.count("row").over(w)).join(offsets, ["series", "bucket"])
              .withColumn("pos", F.col("_off") + F.col("_in")))
    total = rows.groupBy("series").agg(F.count("*").alias("_all"))
    ranked = placed.filter("row is not null").select("series", "pos", "row.*")
    # near an end of the curve the window moves inwards, so it always holds 2 (k + 1) rows or the type
    first = F.greatest(F.least(F.col("pos") - k, F.col("_all") - 2 * k - 1), F.lit(1))
    near = (placed.filter("s is not null").join(total, "series")
            .select("series", F.explode(F.sequence(first, first + 2 * k + 1)).alias("pos"), "s.*"))
    pairs = near.join(grown(ranked), ["series", "pos"])
    return _scored(pairs).select(*S_POINT, F.struct("score", "asset_id").alias("c"))


def _level(u: Column) -> Column:
    """Cell size 2^level is between U/2 and U."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(u, F.lit(1e-9)) / 2.0)), F.lit(_MIN_LEVEL)),
                   F.lit(_MAX_LEVEL)).cast("int")


def _gap(x: Column, cell: Column, size: Column) -> Column:
    """Distance from x to the interval of a cell, 0 inside it."""
    return F.greatest(F.lit(0.0), cell * size - x, x - (cell + 1) * size)


def comparables(subjects: DataFrame, pool: DataFrame, k: int = TOP_K,
                few: int = FEW_SUBJECTS) -> DataFrame:
    """subject_id, rank, and the comparable with its distances, score and sentence.

    ``subjects`` has subject_id, asset_id (null for one without an id: then nothing is
    excluded) and the columns of ``POINT``.
    """
    s = subjects.select("subject_id", F.col("asset_id").alias("s_asset_id"),
                        *[F.col(c).alias(f"s_{c}") for c in POINT])
    s = s.withColumn("s_rooms", F.col("s_rooms").cast("bigint"))
    extra = ["price", "bathrooms", "neighborhood_name"]
    not_self = F.col("s_asset_id").isNull() | (F.col("asset_id") != F.col("s_asset_id"))
    if ranks.is_small(s, few):
        # a handful of subjects: one pass over the pool, its rank limit map-side
        hits = pool.select("asset_id", *POINT, *extra).join(
            F.broadcast(s), F.col("property_type") == F.col("s_property_type"))
        # rows without a place, area or rooms have no score, here as in the search below
        return _shape(_top(_scored(hits.filter(not_self)).filter("score is not null"), ["subject_id"], k))

    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in POINT])
    s = s.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in S_POINT]))
    pool = pool.filter(whole)
    w = Window.partitionBy(*POINT).orderBy("asset_id")
    lean = (pool.select("asset_id", *POINT).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= k + 1).drop("_rn"))
    # both sides are read several times below and must not change between the reads
    lean = written(lean, "comps-pool")
    points = written(s.select(*S_POINT).distinct(), "comps-points")
    scale, spans = _frame(lean, points)

    near = reduce(DataFrame.unionByName, [
        _curve_candidates(points, lean, k, scale, spans, shift) for shift in (0.0, 1 / 3)])
    # at most 4(k+1) candidates per point, the same row from both curves counted once
    bound = near.groupBy(*S_POINT).agg(F.sort_array(F.collect_set("c")).alias("c")).select(
        *S_POINT, F.get("c", F.lit(k))["score"].alias("u"))
    # fewer than k+1 rows: the type itself is that small, search everywhere
    far = float(2 ** _MAX_LEVEL)
    bounded = written(points.join(grown(bound), S_POINT, "left").withColumn(
        "u", F.coalesce(F.col("u") * (1 + _SLACK) + _SLACK, F.lit(far))).withColumn("level", _level(F.col("u"))),
        "comps-bounds")

    size = F.pow(F.lit(2.0), F.col("level"))
    levels = bounded.agg(F.collect_set("level")).scalar()
    cells = (lean.withColumn("levels", levels).withColumn("level", F.explode("levels")).drop("levels"))
    for name, axis in zip("abc", _axes(F.col("latitude"), F.col("longitude"), F.col("area_m2"), scale)):
        cells = cells.withColumn(f"c{name}", F.floor(axis / size))
    # km per degree understates arcs up to ~1.5 degrees; beyond, sin x >= 2x/pi still holds
    shrink = F.when(F.col("u") > min(100.0, 1.5 * scale), 2 / math.pi).otherwise(1.0)
    # each point meets dozens of cells and rows, and many points are a small file
    probes = spread(bounded, POINTS_PER_TASK)
    s_axes = dict(zip("abc", _axes(F.col("s_latitude"), F.col("s_longitude"), F.col("s_area_m2"), scale)))
    gaps = {}
    for name, axis in s_axes.items():
        factor = shrink if name in "ab" else F.lit(1.0)
        reach = F.col("u") / factor
        probes = probes.withColumn(f"c{name}", F.explode(F.sequence(
            F.floor((axis - reach) / size), F.floor((axis + reach) / size))))
        gaps[name] = _gap(axis, F.col(f"c{name}"), size) * factor
        flat = F.sqrt(sum((gaps[n] * gaps[n] for n in "ab" if n in gaps), F.lit(0.0)))
        probes = probes.filter(flat + gaps.get("c", F.lit(0.0)) <= F.col("u"))
    key = ["property_type", "level", "ca", "cb", "cc"]
    hits = probes.withColumn("property_type", F.col("s_property_type")).join(grown(cells), key)
    hits = hits.filter((F.abs(F.col("area_m2") - F.col("s_area_m2")) / geo.AREA_SCALE_M2
                        + geo.ROOMS_WEIGHT * F.abs(F.col("rooms") - F.col("s_rooms"))) <= F.col("u"))
    best = _top(_scored(hits).filter(F.col("score") <= F.col("u")), S_POINT, k + 1).drop("rank", "u", "level", "ca", "cb", "cc")
    mine = s.join(grown(best), S_POINT).filter(not_self)
    final = _top(mine, ["subject_id"], k)
    return _shape(final.join(grown(pool.select("asset_id", *extra)), "asset_id"))


def _shape(df: DataFrame) -> DataFrame:
    return df.withColumn("why", comp_why()).select(
        "subject_id", "rank", "asset_id", "price", "area_m2", "rooms", "bathrooms", "property_type",
        "neighborhood_name", "distance_km", "area_diff_m2", "rooms_diff", "score", "why",
        "latitude", "longitude")


def comp_why() -> Column:
    """One sentence per comparable."""
    return F.concat(
        fixed(F.col("distance_km"), 2), F.lit(" km from the subject, "), fixed(F.col("area_m2"), 0),
        F.lit(" m2 vs "), fixed(F.col("s_area_m2"), 0), F.lit(" m2, "), F.col("rooms").cast("string"),
        F.lit(" rooms vs "), F.col("s_rooms").cast("string"), F.lit(", same property type ("),
        F.col("property_type"), F.lit(")"))


def comps_summary(comps: DataFrame) -> DataFrame:
    """n, price range and median, farthest distance per subject (at most k rows each)."""
    return comps.groupBy("subject_id").agg(
        F.count("*").alias("n"), F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        F.percentile("price", 0.5).alias("price_median"), F.max("distance_km").alias("max_distance_km"))


def method_text(k: int = TOP_K) -> str:
    return (f"same property_type as the subject, ranked by score = distance_km + "
            f"area_diff_m2/{geo.AREA_SCALE_M2:g} + {geo.ROOMS_WEIGHT:g}*rooms_diff, top {k} kept")


def map_points(subjects: DataFrame, comps: DataFrame) -> DataFrame:
    """The subject's point and one point per comparable, with label and radius class."""
    me = subjects.select("subject_id", F.lit("subject").alias("role"), "latitude", "longitude",
                         F.concat(F.lit("Subject ("), F.col("asset_id"), F.lit(")")).alias("label"),
                         F.lit(90).alias("radius"))
    them = comps.select("subject_id", F.lit("comp").alias("role"), "latitude", "longitude", F.concat(
        F.lit("Comp ("), F.col("asset_id"), F.lit(", EUR "), F.format_number("price", 0), F.lit(")")).alias("label"),
        F.lit(60).alias("radius"))
    return me.unionByName(them)
