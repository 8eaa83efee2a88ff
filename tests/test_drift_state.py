"""States of batches add up, a stream can feed them, and both code paths agree with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_spark.operators import curate, drift

COLS = ["a", "b", "never"]


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(4)
    make = lambda n, shift: spark.createDataFrame(
        [(float(round(x, 1)), float(y) if i % 7 else (None if i % 2 else float("nan")), None) for i, (x, y) in enumerate(
            zip(rng.normal(shift, 1, n), rng.integers(0, 5, n)))], "a double, b double, never double")
    return make(3000, 0.0).persist(), make(1100, 0.6).persist()


def table(df):
    return {r["feature"]: tuple(round(r[c], 9) if r[c] == r[c] else None for c in ("psi", "ks_statistic", "ks_p_value")) + (r["drifted"],) for r in df.collect()}


def test_against_numpy(sides):
    ref, cur = ([r["a"] for r in s.collect()] for s in sides)
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    share = [np.maximum(np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=len(edges) - 1) / len(x), 1e-6) for x in (ref, cur)]
    psi = float(((share[1] - share[0]) * np.log(share[1] / share[0])).sum())
    at = np.unique(ref + cur)
    d = float(np.abs(np.searchsorted(np.sort(ref), at, side="right") / len(ref) - np.searchsorted(np.sort(cur), at, side="right") / len(cur)).max())
    got = table(drift.drift_of(drift.state(*sides, COLS), COLS))
    assert got["a"][0] == pytest.approx(psi) and got["a"][1] == pytest.approx(d) and got["a"][3] is True
    assert got["never"] == (None, None, None, False)


def test_batches_add_up(sides, tmp_path, spark):
    ref, cur = sides
    whole = table(drift.drift_of(drift.state(ref, cur, COLS), COLS))
    assert whole == table(drift.drift_of(drift.state(ref, cur, COLS), COLS, small=False))
    parts = drift.state(ref, None, COLS).unionByName(drift.state(None, cur.filter("a < 0.5"), COLS)).unionByName(drift.state(None, cur.filter("a >= 0.5"), COLS))
    assert table(drift.drift_of(drift.merged(parts), COLS)) == whole
    folder = str(tmp_path / "state")
    drift.add_batch(ref, 0, folder, COLS, "ref")
    for i, part in enumerate((cur.filter("a < 0"), cur.filter("a >= 0"), cur.filter("a < 0"))):
        drift.add_batch(part, i % 2, folder, COLS)               # batch 0 comes twice
    assert table(drift.drift_of(drift.read_state(spark, folder), COLS)) == whole


def test_a_stream_feeds_the_state(sides, tmp_path, spark):
    ref, cur = sides
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    cur.repartition(3).write.parquet(source)
    drift.add_batch(ref, 0, folder, COLS, "ref")
    stream = spark.readStream.schema(cur.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = stream.writeStream.foreachBatch(lambda df, i: drift.add_batch(df, i, folder, COLS)).option(
        "checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert drift.read_state(spark, folder).agg(F.sum("cur")).first()[0] == drift.state(None, cur, COLS).agg(F.sum("cur")).first()[0]
    assert table(drift.drift_of(drift.read_state(spark, folder), COLS)) == table(drift.drift_of(drift.state(ref, cur, COLS), COLS))


def test_stage_counts_are_those_of_the_tables(spark, sf):
    got = curate.stage_counts(spark, sf)
    listings = curate.curated(spark, sf)
    assert got == {"raw": curate.raw(spark, sf).count(), "deduped": curate.deduped(spark, sf).count(), "valid": curate.valid(spark, sf).count(),
                   "trimmed": listings.count(), "zone_match": listings.filter("neighborhood_id is not null").count()}
