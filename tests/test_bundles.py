"""Stored bundles score as the ones in memory; splits and runs are found again or refused."""

import pytest

from estate_spark.operators import bundles, curate, models
from estate_spark.plans import modelling, sampling


def test_a_stored_bundle_scores_the_same(spark, sf, tmp_path):
    b, rows = modelling.bundle(spark, sf), curate.curated(spark, sf)
    with pytest.raises(Exception):
        bundles.load_production(spark, str(tmp_path))
    bundles.save_bundle(spark, b, str(tmp_path), production=False)
    with pytest.raises(LookupError):
        bundles.load_production(spark, str(tmp_path))
    bundles.save_bundle(spark, b, str(tmp_path), production=True, params={"split_seed": "42"})
    back = bundles.load_production(spark, str(tmp_path))
    assert back.prep == b.prep and back.info() == b.info()
    a, c = ({r["asset_id"]: tuple(r) for r in models.score(rows, x).collect()} for x in (b, back))
    assert a == c
    log = bundles.run_rows(spark, str(tmp_path)).filter("is_production").first()
    assert log["run_id"] == b.run_id and log["metrics"]["mae"] == pytest.approx(b.test_metrics["mae"]) and log["params"] == {"split_seed": "42"}


def test_a_stored_split_is_kept(spark, sf, tmp_path):
    path = str(tmp_path / "split")
    with pytest.raises(Exception):
        bundles.load_split(spark, path).count()
    bundles.save_split(sampling.split(spark, sf), path)
    assert sorted(map(tuple, bundles.load_split(spark, path).collect())) == sorted(map(tuple, sampling.split(spark, sf).select("asset_id", "split").collect()))
    with pytest.raises(Exception):
        bundles.save_split(sampling.split(spark, sf), path)
