"""Zones, comparables and tiles on small literal cases and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from estate_spark.operators import comps, spatial, tiles
from estate_spark.sources.io import load_zones

SQUARE_WITH_HOLE = "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 1, 0 0), (0.4 0.4, 0.6 0.4, 0.6 0.6, 0.4 0.6, 0.4 0.4)))"
TWO_PARTS = "MULTIPOLYGON(((2 0, 3 0, 3 1, 2 1, 2 0)), ((2 2, 3 2, 2.5 3, 2 2)))"
OVERLAP = "MULTIPOLYGON(((0.8 0, 1.5 0, 1.5 1, 0.8 1, 0.8 0)))"


@pytest.fixture(scope="module")
def zones(spark):
    rows = [("a", "A", SQUARE_WITH_HOLE), ("b", "B", TWO_PARTS), ("c", "C", OVERLAP)]
    return load_zones(spark.createDataFrame(rows, "LOCATIONID string, LOCATIONNAME string, wkt string")).withColumn(
        "zone_order", F.col("LOCATIONID"))


@pytest.mark.parametrize("x,y,zone", [
    (0.2, 0.2, "a"), (0.5, 0.5, None), (0.4, 0.5, None), (0.0, 0.5, None), (1.0, 1.0, None), (0.5, 1.0, None),
    (2.5, 0.5, "b"), (2.5, 2.5, "b"), (2.5, 1.5, None), (0.9, 0.5, "a"), (1.2, 0.5, "c"), (5.0, 5.0, None),
    (1.0, 0.5, "c")])
def test_point_in_zone(spark, zones, x, y, zone):
    for cell in (0.05, 0.7):
        pts = spark.createDataFrame([(x, y)], "longitude double, latitude double")
        r = spatial.pip_join(pts, zones, cell=cell).collect()
        assert len(r) == 1 and r[0]["neighborhood_id"] == zone


def brute(subjects, pool, k):
    out = {}
    for sid, sasset, st, sla, slo, sa, sr in subjects:
        scored = []
        for aid, t, la, lo, a, r in pool:
            if t != st or aid == sasset:
                continue
            p0, p1 = math.radians(sla), math.radians(la)
            h = math.sin((p1 - p0) / 2) ** 2 + math.cos(p0) * math.cos(p1) * math.sin(math.radians(lo - slo) / 2) ** 2
            scored.append((2 * 6371.0 * math.asin(math.sqrt(h)) + abs(a - sa) / 20 + 0.7 * abs(r - sr), aid))
        out[sid] = [(i + 1, aid, round(s, 6)) for i, (s, aid) in enumerate(sorted(
            (round(s, 9), aid) for s, aid in scored)[:k])]
    return out


def pool_rows(n, seed, spread):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:       # a third of all rows at one place, with few distinct sizes
            la, lo, a = 40.41, -3.7, float(50 + i % 4)
        else:
            la, lo, a = (round(40.4 + rng.uniform(-spread, spread), 4), round(-3.7 + rng.uniform(-spread, spread), 4),
                         float(rng.randint(20, 250)))
        rows.append((f"A{i:05d}", "studio" if i % 50 == 7 else "flat", la, lo, a, rng.randint(0, 5)))
    rows.append(("LONER", "duplex", 40.4, -3.7, 80.0, 2))
    rows.append(("PAIR1", "loft", 40.4, -3.7, 80.0, 2))
    rows.append(("PAIR2", "loft", 45.4, -13.7, 900.0, 2))
    return rows


SCHEMA = ("asset_id string, property_type string, latitude double, longitude double, area_m2 double, rooms long")


def as_pool(spark, rows):
    return (spark.createDataFrame(rows, SCHEMA).withColumn("price", F.lit(1.0)).withColumn("bathrooms", F.lit(1))
            .withColumn("neighborhood_name", F.lit("z")))


@pytest.mark.parametrize("spread", [0.2, 20.0])
def test_bulk_comparables_against_brute_force(spark, spread):
    rows = pool_rows(600, 3, spread)
    pool = as_pool(spark, rows)
    subs = [(r[0], r[0], *r[1:]) for r in rows]
    subs += [("entered", None, "flat", 40.41, -3.7, 51.0, 2), ("far", None, "flat", -33.9, 151.2, 60.0, 3)]
    s = spark.createDataFrame(subs, "subject_id string, " + SCHEMA)
    got = {}
    for r in comps.comparables(s, pool, 5).collect():
        got.setdefault(r["subject_id"], []).append((r["rank"], r["asset_id"], round(r["score"], 6)))
    want = {k: v for k, v in brute(subs, rows, 5).items() if v}
    assert got.keys() == want.keys() and "LONER" not in got
    for sid in want:
        assert [round(x[2], 5) for x in sorted(got[sid])] == pytest.approx([x[2] for x in want[sid]], abs=2e-5)
        assert [x[1] for x in sorted(got[sid])] == [x[1] for x in want[sid]], sid


def test_few_subjects_path(spark):
    rows = pool_rows(200, 9, 0.1)
    subs = [(r[0], r[0], *r[1:]) for r in rows[:5]]
    got = {}
    for r in comps.comparables(spark.createDataFrame(subs, "subject_id string, " + SCHEMA), as_pool(spark, rows)).collect():
        got.setdefault(r["subject_id"], []).append((r["rank"], r["asset_id"], round(r["score"], 6)))
    want = brute(subs, rows, 5)
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == {k: [x[1] for x in v] for k, v in want.items()}


def test_majority_label_tie_is_positive(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0, 1), ("t", 1.0, 2.0, 0)], "tile_id string, tile_lat double, tile_lon double, label int")
    assert tiles.tile_labels(df).first()["tile_label"] == 1


def test_tile_id_text(spark):
    df = spark.createDataFrame([(40.28005, -3.7, "new"), (40.41234, -3.70004, "needs_renovation")],
                               "latitude double, longitude double, condition string")
    got = [(r["tile_id"], r["label"]) for r in tiles.with_tile(df).collect()]
    assert got[1] == ("40.4123_-3.7000", 0) and got[0][0].endswith("_-3.7000") and got[0][1] == 1
