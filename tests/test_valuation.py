"""Cases and reports of every listing: nothing withheld, measured coverage, the trained bundle."""

import json

import pytest
from pyspark.sql import functions as F

from estate_spark.operators import curate, report, valuation
from estate_spark.plans.modelling import bundle
from estate_spark.plans.neighbours import all_comps, subjects
from estate_spark.plans.reporting import bundle_reports, cases
from estate_spark.plans.sampling import split


@pytest.mark.parametrize("small", [True, False])
def test_conformal_band_against_a_loop(spark, small):
    rows = [(f"a{i}", 100.0 + 3 * i, 100.0 + (i * 37 % 101), ["val", "test", "train"][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "subject_id string, estimate double, price double, split string")
    got = {r["subject_id"]: r for r in valuation.conformal(df, "price", small=small).collect()}
    errors = sorted(abs(p - e) for _, e, p, s in rows if s == "val")
    k = min(-int(-(len(errors) + 1) * (0.95 - 0.05) // 1), len(errors))
    q = errors[k - 1]
    test = [(e, p) for _, e, p, s in rows if s == "test"]
    covered = sum(e - q <= p <= e + q for e, p in test) / len(test)
    assert len(got) == len(rows)
    for i, e, _, _ in rows:
        assert (got[i]["low"], got[i]["high"]) == (e - q, e + q)
        assert got[i]["interval_test_coverage"] == pytest.approx(covered, abs=1e-12) and got[i]["interval_coverage"] == 0.9


def test_every_listing_has_all_branches(spark, sf):
    c, n = cases(spark, sf), curate.curated(spark, sf).count()
    alone = curate.curated(spark, sf).groupBy("property_type").count().filter("count = 1").count()
    r = c.agg(F.count("*").alias("n"), F.count("valuation").alias("v"), F.count("comps").alias("c"), F.count("energy").alias("e"),
              F.countDistinct("valuation.interval_test_coverage").alias("m")).first()
    assert (r["n"], r["v"], r["c"], r["e"], r["m"]) == (n, n, n - alone, n, 1)


def test_stated_coverage_is_the_measured_one(spark, sf):
    rows = cases(spark, sf).join(split(spark, sf).filter("split = 'test'").withColumnRenamed("asset_id", "subject_id").select("subject_id"),
                                 "subject_id").select("price", "valuation.*", F.array_join(report.required_items(), "|").alias("req")).collect()
    covered = sum(r["low"] <= r["price"] <= r["high"] for r in rows) / len(rows)
    assert rows and all(abs(r["interval_test_coverage"] - covered) < 1e-12 for r in rows)
    assert all(f"{100 * covered:.1f}" in r["req"].split("|") for r in rows)


def test_missing_branches_come_from_the_data(spark, sf):
    """A type nobody else has and an id nobody valued."""
    base = subjects(spark, sf).limit(2)
    odd = base.withColumns({"subject_id": F.concat(F.lit("x"), "asset_id"), "property_type": F.lit("castle")})
    val = cases(spark, sf).select("subject_id", "valuation.*")
    out = valuation.cases(odd, curate.curated(spark, sf), val, all_comps(spark, sf)).collect()
    assert len(out) == 2
    for r in out:
        assert r["errors"] == ["comparables_agent: no listings share property_type 'castle'", f"valuation_agent: no valuation for {r['subject_id']}"]
    assert valuation.cases(odd.limit(0), curate.curated(spark, sf), val, all_comps(spark, sf)).count() == 0


def test_reports_on_the_trained_bundle(spark, sf):
    b, rows = bundle(spark, sf), bundle_reports(spark, sf).collect()
    assert len(rows) == curate.curated(spark, sf).count()
    for r in rows:
        assert r["error"] is None and r["low"] <= r["estimate"] <= r["high"]
        assert r["interval_test_coverage"] == b.test_coverage and f"{100 * b.test_coverage:.1f}%" in r["narrative"]
        assert r["narrative_source"] == "template" and json.loads(r["json"])["asset_id"] == r["subject_id"]
