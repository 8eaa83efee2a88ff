"""Cases for reports: valuation, comparables and energy of every subject, merged.

The valuation is a point, a conformal band around it and its drivers; the coverage stated
with it is the one measured on held-out rows. A branch is missing only where the data give
nothing: a subject whose type no other listing has, or an id without a valuation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.operators import energy, evaluate, explain, models, report
from estate_spark.session import grown


def conformal(points: DataFrame, y: str, split: str = "split", point: str = "estimate",
              small: bool | None = None) -> DataFrame:
    """points' columns but y and split, low, high, interval_coverage and the measured
    interval_test_coverage: the band's half width is the rank of the nominal coverage among
    the absolute errors of the validation rows. The two figures are one row each."""
    raw = points.withColumns({"q05": F.col(point), "q95": F.col(point)})
    cal = evaluate.cqr_calibrate(raw.filter(F.col(split) == "val"), y, "q05", "q95", small=small)
    band = evaluate.apply_band(raw, cal.select("calibration_q").scalar(), point)
    measured = evaluate.coverage(band.filter(F.col(split) == "test"), y, "low", "high")
    keep = [c for c in points.columns if c not in (y, split)]
    return band.select(*keep, "low", "high", F.lit(evaluate.NOMINAL_COVERAGE).alias("interval_coverage"),
                       measured.select("coverage").scalar().alias("interval_test_coverage"))


def by_bundle(subjects: DataFrame, bundle: models.Bundle) -> DataFrame:
    """subject_id, estimate, band, coverages and drivers by a trained bundle, for any rows with
    the usable features and the zone's name."""
    key = "subject_id"
    said = explain.explain(subjects, explain.shap_rows(subjects, bundle, key), key=key)
    scored = models.score(subjects, bundle, [key])
    return scored.join(grown(said.select(key, "top_drivers", "driver_text")), key)


def cases(subjects: DataFrame, listings: DataFrame, valuations: DataFrame, comps: DataFrame) -> DataFrame:
    """One case a subject, for ``report``; the energy branch is computed for every subject."""
    return report.fan_in(subjects, valuations, comps, energy.energy(subjects, listings))


def priced(linear: DataFrame, listings: DataFrame, split: DataFrame) -> DataFrame:
    """The output of ``explain`` with the price and split that a conformal band needs."""
    return linear.join(grown(listings.select("asset_id", C.TARGET)), "asset_id").join(grown(split.select("asset_id", "split")), "asset_id")
