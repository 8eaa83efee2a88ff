"""The search for comparables deals its points out and broadcasts nothing that grows."""

import re

from estate_spark.operators import comps, curate
from estate_spark.plans import neighbours


def test_search_is_dealt_out_and_broadcasts_no_cells(spark, sf, monkeypatch):
    listings = curate.curated(spark, sf)
    s = neighbours.subjects(spark, sf)
    want = {(r["subject_id"], r["rank"], r["asset_id"]) for r in neighbours.all_comps(spark, sf).collect()}
    monkeypatch.setattr(comps, "POINTS_PER_TASK", 10)
    found = comps.comparables(s, listings)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"RoundRobinPartitioning\((\d{2,})\)", found._jdf.queryExecution().executedPlan().toString())
    assert {(r["subject_id"], r["rank"], r["asset_id"]) for r in found.collect()} == want
