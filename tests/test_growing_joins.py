"""Tables that grow with the input are joined by shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from estate_spark.operators import curate, energy, explain, report, valuation
from estate_spark.plans import neighbours
from estate_spark.plans.modelling import explained, linear_shap
from estate_spark.plans.sampling import split
from estate_spark.session import written


def broadcasts(df):
    """Broadcast join sides of the physical plan, as the planner sees them before running."""
    return len(re.findall(r"BroadcastExchange", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def listings(spark, sf):
    return curate.curated(spark, sf)


def test_valuations_and_cases_broadcast_no_growing_table(spark, sf, listings):
    assert broadcasts(explained(spark, sf)) == 0
    points = valuation.priced(explained(spark, sf), listings, split(spark, sf))
    assert broadcasts(points) == 0
    s = neighbours.subjects(spark, sf)
    val = written(points.withColumnRenamed("asset_id", "subject_id"), "test-points")
    found, bands = neighbours.all_comps(spark, sf), written(energy.energy(s, listings), "test-energy")
    assert broadcasts(report.fan_in(s, val, found, bands)) == 0


def test_cache_broadcasts_no_growing_table(spark, sf, listings):
    cache = written(linear_shap(spark, sf).withColumn("run_id", F.lit("r")), "test-cache")
    assert broadcasts(explain.cache_or_compute(listings, cache, lambda d: linear_shap(spark, sf, d), "r")) == 0
