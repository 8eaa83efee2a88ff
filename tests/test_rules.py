"""Literal cases: energy bands, drivers, texts, guards, fail-closed reports."""

import pytest
from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.functions import labels, rules, text
from estate_spark.operators import curate, drift, evaluate, explain, features, lookup, report
from estate_spark.plans.reporting import cases


def one(df, *cols):
    return df.select(*cols).first()


@pytest.mark.parametrize("condition,year,cad,band,flag,source", [
    ("good", 1950, None, "F", True, "construction_year"), ("good", 1995, None, "E", False, "construction_year"),
    ("good", 2010, None, "C", False, "construction_year"), ("new", None, None, "C", False, "condition"),
    ("good", None, 1623, "unknown", False, None), ("good", 1700, 1990, "E", False, "cad_construction_year"),
    ("new", 1950, None, "C", False, "construction_year")])
def test_energy_band(spark, condition, year, cad, band, flag, source):
    df = spark.createDataFrame([(condition, year, cad)], "condition string, construction_year long, cad_construction_year long")
    r = rules.with_energy_band(df).first()
    assert (r["band"], r["flag"], r["year_source"]) == (band, flag, source)


def test_coalesced_year_hides_a_valid_second_year(spark):
    df = spark.createDataFrame([(1700, 1990), (None, 1990)], "construction_year long, cad_construction_year long")
    assert [r["year"] for r in rules.with_coalesced_year(df).collect()] == [1990]


def test_dedupe_keeps_latest_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", 201803, 1), ("a", 201812, 2), ("a", 201812, 3), ("b", 201806, 4)],
                               "asset_id string, period long, seq long")
    got = sorted((r["asset_id"], r["seq"]) for r in curate.dedupe_latest(df, "asset_id", ["period", "seq"]).collect())
    assert got == [("a", 3), ("b", 4)]


def test_validity_is_inclusive_and_null_fails(spark):
    rows = [(1.0, 1.0, 1.0, 40.30, -3.90), (1.0, 1.0, 1.0, 40.60, -3.55), (0.0, 1.0, 1.0, 40.4, -3.7),
            (1.0, None, 1.0, 40.4, -3.7), (1.0, 1.0, 1.0, 40.61, -3.7)]
    df = spark.createDataFrame(rows, "price double, area_m2 double, unit_price_m2 double, latitude double, longitude double")
    assert curate.hard_validity(df).count() == 2


def test_contract_shape():
    roles = C.feature_roles()
    assert (len(C.NAMES), len(C.COLUMN_MAP), len(roles.model), len(roles.usable), len(roles.numeric)) == (44, 38, 39, 38, 35)
    with pytest.raises(ValueError):
        C.assert_no_leakage(["area_m2", "unit_price_m2"])
    assert C.struct_type().names == C.NAMES


def test_projection_refuses_missing_columns(spark):
    with pytest.raises(ValueError):
        C.project_contract(spark.range(1))


def test_top_drivers_literal(spark):
    vals = {"area_m2": 40000.0, "has_lift": -2000.0, "condition": 15000.0, "floor": -500.0}
    df = spark.createDataFrame([(80.0, 0, "good", 3, "z")], "area_m2 double, has_lift int, condition string, floor int, neighborhood_name string")
    df = df.withColumns({explain.PREFIX + k: F.lit(v) for k, v in vals.items()})
    d = df.select(explain.drivers_of(list(vals), 2).alias("d")).first()["d"]
    assert [(x["feature"], x["shap_eur"]) for x in d] == [("area_m2", 40000.0), ("condition", 15000.0)]
    assert d[1]["description"] == "condition (good)"
    t = df.select(explain.driver_text(F.lit(340000.0), explain.drivers_of(list(vals), 3)).alias("t")).first()["t"]
    assert t == ("Estimated value is 340,000 euros. Size (80 m2) adds 40,000 euros, condition (good) adds 15,000 euros, "
                 "not having a lift subtracts 2,000 euros.")


def test_labels(spark):
    df = spark.createDataFrame([(0, None, 1234.5, "Z1", "Sol")], "has_lift int, floor int, parking_space_price double, neighborhood_id string, n string")
    r = df.select(labels.describe("has_lift", F.col("has_lift")).alias("a"), labels.describe("floor", F.col("floor")).alias("b"),
                  labels.describe("parking_space_price", F.col("parking_space_price")).alias("c"),
                  labels.describe("neighborhood_id", F.col("neighborhood_id"), F.col("n")).alias("d"),
                  labels.describe("some_thing", F.lit(1)).alias("e")).first()
    assert tuple(r) == ("not having a lift", "floor level", "parking space price (1,234 euros)", "neighborhood (Sol)", "some thing")


@pytest.mark.parametrize("raw,numbers", [
    ("A100 costs 1,234,567.50 euros, up 3.5% from 12", ["1234567.50", "3.5", "12"]), ("none here", []),
    ("listing A123 and 999,731", ["999731"])])
def test_extract_numbers(spark, raw, numbers):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.extract_numbers(F.col("t")).alias("n")).first()["n"] == numbers


@pytest.mark.parametrize("raw,problems", [
    ("A Robust plan", ["contains banned word 'robust'"]), ("ROBUSTLY and vitality", ["contains banned word 'robust'", "contains banned word 'vital'"]),
    ("unvital, corobust", []), ("évital and _vital", []), ("pre-vital", ["contains banned word 'vital'"]), ("plain", [])])
def test_banned_words(spark, raw, problems):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.word_problems(F.col("t")).alias("p")).first()["p"] == problems


def test_rounding_is_half_even(spark):
    r = spark.range(1).select(text.format_eur(F.lit(2.5)), text.format_eur(F.lit(1234567.0)), text.fixed(F.lit(0.125), 2),
                              text.fixed(F.lit(1234.5), 0), text.pct1(F.lit(0.903))).first()
    assert tuple(r) == ("2", "1,234,567", "0.12", "1234", "90.3")


@pytest.mark.parametrize("p,shown", [(0.0, "0"), (1.0, "1"), (0.5, "0.5"), (0.12345, "0.1235"), (0.00012346, "0.0001235"),
                                     (0.0000123456, "1.235e-05"), (1e-12, "1e-12"), (0.99999, "1")])
def test_general_4(spark, p, shown):
    assert spark.range(1).select(drift.general_4(F.lit(p))).first()[0] == shown


def test_form_errors_first_rule_wins(spark):
    cols = "area_m2 double, rooms double, bathrooms double, floor double, construction_year double, latitude double, longitude double"
    rows = [(80.0, 2.0, 1.0, 1.0, 1990.0, 40.4, -3.7), (5.0, 2.5, 1.0, 1.0, 1990.0, 40.4, -3.7),
            (80.0, 2.5, 1.0, 1.0, 1990.0, 40.4, -3.7), (80.0, 2.0, 1.0, 1.0, 1990.0, None, -3.7)]
    got = [r[0] for r in spark.createDataFrame(rows, cols).select(rules.form_error()).collect()]
    assert got[0] is None and got[1].startswith("Area") and got[2].startswith("Rooms") and got[3] == rules.NO_LOCATION


def test_join_guards(spark):
    a = spark.createDataFrame([("x", 1.0)], "k string, score double")
    b = spark.createDataFrame([("y", 2.0)], "k string, score double")
    with pytest.raises(ValueError):
        lookup.guarded_join(a, b, "k")
    with pytest.raises(Exception, match="no partner"):
        lookup.join_keeping_all(a, b.drop("score"), "k").collect()


def test_band_order_pad_swap_include(spark):
    df = spark.createDataFrame([(100.0, 90.0, 110.0), (100.0, 120.0, 100.5), (200.0, 90.0, 110.0)], "estimate double, q05 double, q95 double")
    r = evaluate.apply_band(df, F.lit(-5.0)).collect()
    assert (r[0]["low"], r[0]["high"], r[0]["corrected"]) == (95.0, 105.0, False)
    assert r[1]["crossing"] and r[1]["low"] == 95.5 and r[1]["high"] == 125.0
    assert r[2]["point_excluded"] and r[2]["high"] == 200.0


@pytest.mark.parametrize("small", [True, False])
def test_cqr_rank_is_capped(spark, small):
    df = spark.createDataFrame([(float(i), 0.0, 0.0) for i in range(1, 6)], "y double, lo double, hi double")
    r = evaluate.cqr_calibrate(df, "y", "lo", "hi", small=small).first()
    assert (r["n"], r["k"], r["calibration_q"]) == (5, 5, 5.0)


def test_zero_std_counts_as_one_and_unseen_level(spark):
    tr = spark.createDataFrame([(1.0, 1990, "a"), (1.0, None, "b")], "x double, construction_year long, c string")
    p = features.fit(tr, ["x", "construction_year"], ["c"])
    assert p.stds["x"] == 1.0
    new = spark.createDataFrame([(None, None, "zzz")], "x double, construction_year long, c string")
    levels, filled = features.fit_levels(tr, ["c"]), features.standardize(features.impute(new, p), p)
    r, hot = features.encode(filled, levels, ["c"]).first(), features.one_hot(filled, levels, ["c"]).first()
    assert (r["x"], r["year_missing"], r["c_index"], hot["c_onehot"].toArray().tolist()) == (0.0, 1.0, None, [0.0, 0.0, 1.0])


def test_placeholder_is_dropped_from_posted_rows(spark):
    df = spark.createDataFrame([(80.0, 0.9, "note")], "area_m2 double, cnn_condition_score double, extra string")
    out = rules.align(df, C.feature_roles().usable, C.TYPES)
    assert out.columns == C.feature_roles().usable and "cnn_condition_score" not in out.columns


def test_payload_fails_closed(spark, sf):
    withheld = F.when(F.substring("subject_id", -1, 1) != "3", F.col("valuation"))
    p = report.payload(cases(spark, sf).withColumn("valuation", withheld))
    bad = p.filter("error is not null").collect()
    assert bad and all(r["payload"] is None and not any(ch.isdigit() for ch in r["json"]) for r in bad)
    assert p.filter("error is null and payload is null").count() == 0


def test_stray_number_is_rejected(spark, sf):
    c = cases(spark, sf).withColumn("cand", F.concat(F.array_join(report.build_facts(), " "), F.lit(" 999,731")))
    out = report.narrative(c, "cand").filter("valuation is not null").collect()
    assert out and all(r["narrative_source"] == "template" and "999731" in r["errors"][-1] for r in out)
