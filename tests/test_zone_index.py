"""The zone index against a plain ray cast: long outlines, aligned grids, holes, corners."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_spark.operators import spatial
from estate_spark.sources.io import load_zones


def outline(rng, n, cx, cy, r, digits=None):
    ring = []
    for i in range(n):
        t = 2 * math.pi * i / n
        d = r * (1 + 0.3 * math.sin(9 * t) + 0.02 * rng.random())
        ring.append((cx + d * math.cos(t), cy + d * math.sin(t)))
    return [(round(x, digits), round(y, digits)) for x, y in ring] if digits is not None else ring


def wkt(*rings):
    return "MULTIPOLYGON((" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + "))"


def plain(rings, px, py):
    """(inside by even-odd, on an edge) of many points, one edge at a time."""
    odd, on = np.zeros(len(px), bool), np.zeros(len(px), bool)
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]]):
            c = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            odd ^= ((y1 <= py) & (y2 > py) & (c > 0)) | ((y2 <= py) & (y1 > py) & (c < 0))
            on |= (c == 0) & (px >= min(x1, x2)) & (px <= max(x1, x2)) & (py >= min(y1, y2)) & (py <= max(y1, y2))
    return odd & ~on


def found(spark, shapes, px, py, cell):
    zones = load_zones(spark.createDataFrame([(k, k, wkt(*r)) for k, r in shapes.items()], "LOCATIONID string, LOCATIONNAME string, wkt string")).withColumn(
        "zone_order", F.col("LOCATIONID"))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(px, py))], "i long, longitude double, latitude double")
    return [r["neighborhood_id"] for r in spatial.pip_join(pts, zones, cell=cell).orderBy("i").collect()]


@pytest.mark.parametrize("cell", [None, 0.037, 0.5, 1.0, 3.0])
def test_against_a_plain_ray_cast(spark, cell):
    rng = random.Random(1)
    shapes = {"a": [outline(rng, 300, 0.1, 0.2, 1.0), outline(rng, 40, 0.1, 0.2, 0.3)],
              "b": [outline(rng, 60, 1.5, 0.3, 0.8, 1)],                                # round coordinates, repeated corners
              "c": [[(-2.0, -2.0), (3.0, -2.0), (3.0, -1.0), (0.0, -1.0), (0.0, -1.5), (-1.0, -1.5), (-1.0, -1.0), (-2.0, -1.0)]],
              "d": [[(0.0, 2.0), (1.0, 3.0), (2.0, 2.0), (1.0, 1.0)], [(0.5, 2.0), (1.0, 2.5), (1.5, 2.0), (1.0, 1.5)]]}
    px = np.array([rng.uniform(-2.5, 3.5) for _ in range(1500)] + [x / 4 for x in range(-10, 14) for _ in range(-10, 14)])
    py = np.array([rng.uniform(-2.5, 3.5) for _ in range(1500)] + [y / 4 for _ in range(-10, 14) for y in range(-10, 14)])
    corners = [p for rings in shapes.values() for r in rings for p in r]
    px, py = np.append(px, [x for x, _ in corners]), np.append(py, [y for _, y in corners])
    want = np.full(len(px), None, object)
    for k in sorted(shapes, reverse=True):
        want[plain(shapes[k], px, py)] = k
    assert found(spark, shapes, px, py, cell) == want.tolist()


def test_long_outline_is_clipped(spark):
    """A cell carries the edges that cross it alone, also of a zone with 100,000 corners."""
    rng = random.Random(2)
    ring = outline(rng, 100_000, 0.0, 0.0, 1.0)
    zones = load_zones(spark.createDataFrame([("z", "Z", wkt(ring))], "LOCATIONID string, LOCATIONNAME string, wkt string")).withColumn("zone_order", F.lit(1))
    cell = spatial.cell_size(zones)
    cells = spatial.zone_cells(zones, cell).select("cell_x", "cell_y", F.explode("zones").alias("z"), F.size("z.edges").alias("n")).cache()
    assert cells.agg(F.max("n")).first()[0] < 2000 and cells.agg(F.sum(F.greatest("n", F.lit(0)))).first()[0] < 400_000
    gap = cells.filter("n > 0").select("cell_x", "cell_y", F.explode("z.edges").alias("e")).filter(
        (F.greatest("e.x1", "e.x2") < F.col("cell_x") * cell - 1e-6) | (F.least("e.x1", "e.x2") > (F.col("cell_x") + 1) * cell + 1e-6)
        | (F.greatest("e.y1", "e.y2") < F.col("cell_y") * cell - 1e-6) | (F.least("e.y1", "e.y2") > (F.col("cell_y") + 1) * cell + 1e-6))
    assert gap.count() == 0
    px, py = np.array([rng.uniform(-1.4, 1.4) for _ in range(300)]), np.array([rng.uniform(-1.4, 1.4) for _ in range(300)])
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(px, py))], "i long, longitude double, latitude double")
    got = [r["neighborhood_id"] == "z" for r in spatial.pip_join(pts, zones).orderBy("i").collect()]
    assert got == plain([ring], px, py).tolist()


def test_points_without_a_place(spark):
    got = found(spark, {"a": [[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]]}, [float("nan"), 0.0, 1e300], [0.0, 0.0, 0.0], 0.5)
    assert got == [None, "a", None]
    empty = load_zones(spark.createDataFrame([], "LOCATIONID string, LOCATIONNAME string, wkt string")).withColumn("zone_order", F.lit(1))
    pts = spark.createDataFrame([(0.0, 0.0), (None, 1.0)], "longitude double, latitude double")
    assert [r["neighborhood_id"] for r in spatial.pip_join(pts, empty).collect()] == [None, None]
