"""Point in polygon as a grid-cell equi-join; a cell carries only the edges that cross it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CELLS = 2 ** 20             # of all zones' boxes together, where the cell size is chosen
_OFF_X, _OFF_Y = 0.5 + 0.0070710678, 0.5 - 0.0057735027     # anchors lie off any round grid
_EDGE_MARGIN = 1e-9              # a point may round into the cell next to its own


def _cross(e: Column, x: Column, y: Column) -> Column:
    """Positive left of the edge, negative right of it, 0 on its line."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def _cell(col: Column, size: float) -> Column:
    return F.floor(col / F.lit(size)).try_cast("int")


def _anchor(cell: Column, off: float, size: float) -> Column:
    return (cell + F.lit(off)) * F.lit(size)


def cell_size(zones: DataFrame) -> float:
    """The median over the zones of the size at which a zone has about as many cells as edges,
    not so small that all boxes together need more than MOST_CELLS."""
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    own = F.sqrt(area / F.greatest(F.size("edges"), F.lit(64)))
    row = zones.filter(area > 0).agg(F.median(own).alias("own"), F.sqrt(F.sum(area) / MOST_CELLS).alias("least")).first()
    return float(max(row["own"], row["least"])) if row["own"] else 1.0


def _edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """zone, e, cell_x, cell_y: every cell that an edge crosses or comes within the margin of:
    columns first, then the rows between the edge's heights at the column's borders."""
    m, e = F.lit(_EDGE_MARGIN), F.col("e")
    low_x, high_x = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    low_y, high_y = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    by_column = edges.withColumn("cell_x", F.explode(F.sequence(_cell(low_x - m, cell), _cell(high_x + m, cell))))

    def height(x: Column) -> Column:
        """The edge's height at x, null for a vertical one."""
        share = F.try_divide(x - e["x1"], e["x2"] - e["x1"])
        return F.when(share.isNotNull(), e["y1"] + F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (e["y2"] - e["y1"]))

    a, b = height(F.col("cell_x") * F.lit(cell) - m), height((F.col("cell_x") + 1) * F.lit(cell) + m)
    bottom, top = F.coalesce(F.least(a, b), low_y), F.coalesce(F.greatest(a, b), high_y)
    return by_column.withColumn("cell_y", F.explode(F.sequence(_cell(bottom - m, cell), _cell(top + m, cell))))


def _inner_anchors(edges: DataFrame, cell: float) -> DataFrame:
    """zone, cell_x, cell_y of the cells whose anchor lies in the zone. A row's anchors share
    one scan line: its crossings with the zone's edges, in order, bound the runs of them."""
    e = F.col("e")
    y = _anchor(F.col("cell_y"), _OFF_Y, cell)
    rows = edges.withColumn("cell_y", F.explode(F.sequence(
        _cell(F.least(e["y1"], e["y2"]), cell), _cell(F.greatest(e["y1"], e["y2"]), cell))))
    met = rows.filter((F.least(e["y1"], e["y2"]) <= y) & (y < F.greatest(e["y1"], e["y2"])))
    at = e["x1"] + F.try_divide(y - e["y1"], e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
    # as many numbers as edges of one zone cross one line
    lines = met.groupBy("zone", "cell_y").agg(F.sort_array(F.collect_list(at)).alias("xs"))
    runs = lines.select("zone", "cell_y", F.explode(F.transform(
        F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(
            F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b")))).alias("run"))
    x = _anchor(F.col("cell_x"), _OFF_X, cell)
    cells = runs.withColumn("cell_x", F.explode(F.sequence(_cell(F.col("run.a"), cell) - 1, _cell(F.col("run.b"), cell) + 1)))
    return cells.filter((F.col("run.a") <= x) & (x < F.col("run.b"))).select("zone", "cell_x", "cell_y")


def zone_cells(zones: DataFrame, cell: float) -> DataFrame:
    """cell_x, cell_y -> the zones that meet the cell, in zone order, as structs of zone, inner
    (whether the cell's anchor lies in the zone) and edges.

    ``edges`` holds the zone's edges that cross the cell and nothing of its other edges, each
    with the side (``left``) on which the anchor lies. Cells without edges lie wholly in the
    zone or are not listed.
    """
    edges = zones.select(F.struct(F.col("zone_order"), F.col("LOCATIONID").alias("zone_id"),
                                  F.col("LOCATIONNAME").alias("zone_name")).alias("zone"), F.explode("edges").alias("e"))
    e = F.col("e")
    x, y = _anchor(F.col("cell_x"), _OFF_X, cell), _anchor(F.col("cell_y"), _OFF_Y, cell)
    side = _cross(e, x, y)
    left = F.when(e["y2"] > e["y1"], side > 0).when(e["y2"] < e["y1"], side >= 0).otherwise(
        F.when(e["x2"] > e["x1"], y >= e["y1"]).otherwise(y < e["y1"]))
    key = ["zone", "cell_x", "cell_y"]
    near = _edge_cells(edges, cell).groupBy(*key).agg(F.collect_list(F.struct(
        *[e[c].alias(c) for c in ("x1", "y1", "x2", "y2")], left.alias("left"))).alias("edges"))
    inner = _inner_anchors(edges, cell).withColumn("inner", F.lit(True))
    cells = near.join(inner, key, "full").withColumn("inner", F.coalesce("inner", F.lit(False)))
    return cells.groupBy("cell_x", "cell_y").agg(F.array_sort(F.collect_list(F.struct("zone", "inner", "edges"))).alias("zones"))


def inside(px: Column, py: Column, ax: Column, ay: Column, zone: Column) -> Column:
    """Even-odd rule over all rings (so holes count), points on an edge excluded.

    The anchor's side is known; every edge of the cell that the way from the point to the
    anchor crosses changes it. Which side of a line a point lies on is the sign of a cross
    product, and a corner on the way counts as left of it for both of its edges.
    """
    def ahead(x: Column, y: Column) -> Column:
        return (ax - px) * (y - py) - (ay - py) * (x - px) >= 0

    def between(e: Column) -> Column:
        return (ahead(e["x1"], e["y1"]) != ahead(e["x2"], e["y2"])) & ((_cross(e, px, py) > 0) != e["left"])

    def touches(e: Column) -> Column:
        return ((_cross(e, px, py) == 0)
                & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    odd = F.size(F.filter(zone["edges"], between)) % 2 == 1
    return F.when(zone["edges"].isNull(), zone["inner"]).otherwise((odd != zone["inner"]) & ~F.exists(zone["edges"], touches))


def pip_join(points: DataFrame, zones: DataFrame, lon: str = "longitude", lat: str = "latitude",
             cell: float | None = None) -> DataFrame:
    """Left-attach neighborhood_id/name: first zone (in zone order) that strictly holds the
    point, null when none does or a coordinate is null or NaN.

    Every cell carries its candidate zones as one array, so each point meets exactly one
    row: no pair explosion and no regrouping by point afterwards. The join strategy is
    left to the planner, which broadcasts the zone side while its size allows and splits
    hot cells of the point side otherwise. ``zones`` needs ``zone_order``; the cell size
    follows from their extents unless it is given.
    """
    cell = cell or cell_size(zones)
    px, py = F.col(lon), F.col(lat)
    known = ~F.isnan(px) & ~F.isnan(py)
    keyed = points.withColumn("cell_x", F.when(known, _cell(px, cell))).withColumn("cell_y", F.when(known, _cell(py, cell)))
    joined = keyed.join(zone_cells(zones, cell), ["cell_x", "cell_y"], "left")
    anchor = _anchor(F.col("cell_x"), _OFF_X, cell), _anchor(F.col("cell_y"), _OFF_Y, cell)
    hits = F.filter("zones", lambda z: inside(px, py, *anchor, z))
    return (joined.withColumn("_hit", F.get(hits, F.lit(0)))
            .withColumn("neighborhood_id", F.col("_hit.zone.zone_id"))
            .withColumn("neighborhood_name", F.col("_hit.zone.zone_name"))
            .drop("_hit", "zones", "cell_x", "cell_y"))
