"""Report assembly: branch merge, facts, narrative with its checks, payload.

A case is one subject row with three nullable structs: ``valuation`` (estimate, low, high,
interval_coverage, interval_test_coverage, driver_text, top_drivers), ``comps`` (items, n,
price_min, price_max, price_median, max_distance_km) and ``energy`` (band, flag,
effective_year, year_source, impact), and the ``errors`` of the branches that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.functions.text import (BANNED_WORDS, fixed, format_eur, pct1,
                                         plural_s, validate_text)
from estate_spark.operators import comps as comps_op
from estate_spark.session import grown

# fixed values
CAVEAT = ("Estimates come from 2018 Madrid asking prices; "
          "this is a historical prototype, not a live market feed.")
ENERGY_DISCLAIMER = ("This is an observed asking-price difference between age bands, "
                     "not a measured effect of the energy rating.")
TEMPLATE_LABEL = ("Template narrative (no LLM backend was reachable; "
                  "the text below is assembled directly from the computed figures).")
NO_ZONE = "an area not matched to a barrio"
NO_COMPS = "Comparable retrieval failed; no comparables are available for this report."
NO_ENERGY = "Energy assessment failed; no energy band is available for this report."
UNKNOWN_BAND = ("Energy: no EPC proxy band could be derived; the build year is missing or invalid. "
                "The band would be a proxy from building age and condition, not a certificate.")
RISK_FLAG = ("Energy risk flag: pre-1980 stock, built before the first Spanish "
             "insulation code (NBE-CT-79).")
PROMPT_HEAD = ("You are a valuation analyst. Write one short valuation narrative "
               "(150 to 230 words, a single flowing text, no headings, no bullet lists) "
               "from the facts below.\n\nHard rules:\n"
               "1. Use only the facts listed below. Every number you write must appear in "
               "the facts exactly as written there. Do not round, convert, total, or invent "
               "any figure.\n"
               "2. Plain direct sentences. No em dashes, no en dashes, straight quotes only.\n"
               f"3. Never use any of these words or their variants: {', '.join(BANNED_WORDS)}.\n"
               "4. Include these sentences verbatim, exactly as written, without the quotes:\n")
PROMPT_MID = ("\n5. State the estimate, both ends of the range, and the measured coverage "
              "figure.\n6. Call the energy band a proxy.\n\nFacts:\n")
NO_VALUATION_NOTE = "narrative_agent: valuation output missing, no summary produced"
NO_BACKEND_NOTE = "narrative_agent: no LLM backend reachable, template fallback used"
VERBATIM_MIN = 20


def nested_comps(comps: DataFrame) -> DataFrame:
    """subject_id and the ``comps`` struct; a subject has at most k rows, so the list is
    bounded."""
    item = F.struct("rank", "asset_id", "price", "area_m2", "rooms", "bathrooms", "property_type",
                    "neighborhood_name", "distance_km", "why", "latitude", "longitude")
    g = comps.groupBy("subject_id").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("n"),
        F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        F.percentile("price", 0.5).alias("price_median"), F.max("distance_km").alias("max_distance_km"))
    return g.select("subject_id", F.struct(*[c for c in g.columns if c != "subject_id"]).alias("comps"))


def fan_in(subjects: DataFrame, valuations: DataFrame, comps: DataFrame, energy: DataFrame) -> DataFrame:
    """Three left joins on the subject; a missing branch is null plus an error text."""
    v = valuations.select("subject_id", F.struct(
        *[c for c in valuations.columns if c != "subject_id"]).alias("valuation"))
    e = energy.select("subject_id", F.struct(*[c for c in energy.columns if c != "subject_id"]).alias("energy"))
    out = (subjects.join(grown(v), "subject_id", "left").join(grown(nested_comps(comps)), "subject_id", "left")
           .join(grown(e), "subject_id", "left"))
    return out.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("comps").isNull(), F.concat(
            F.lit("comparables_agent: no listings share property_type '"), F.col("property_type"), F.lit("'"))),
        F.when(F.col("valuation").isNull(), F.concat(
            F.lit("valuation_agent: no valuation for "), F.col("subject_id"))),
        F.when(F.col("energy").isNull(), F.concat(
            F.lit("energy_agent: no assessment for "), F.col("subject_id"))))))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def build_facts() -> Column:
    """Ordered fact sentences of a case."""
    def v(f):
        return F.col(f"valuation.{f}")

    def c(f):
        return F.col(f"comps.{f}")

    def e(f):
        return F.col(f"energy.{f}")

    def imp(f):
        return F.col(f"energy.impact.{f}")

    rooms, baths = F.col("rooms").cast("bigint"), F.col("bathrooms").cast("bigint")
    zone = F.when(F.length("neighborhood_name") > 0, F.col("neighborhood_name")).otherwise(NO_ZONE)
    subject = _cat("Subject property: a ", F.col("property_type"), " in ", zone, ", ", fixed(F.col("area_m2"), 0),
                   " m2, ", rooms.cast("string"), " room", plural_s(rooms), ", ", baths.cast("string"), " bathroom",
                   plural_s(baths), ", condition ", F.col("condition"), ".")
    value = _cat("Estimated market value: ", format_eur(v("estimate")), " euros, in a range of ", format_eur(v("low")),
                 " to ", format_eur(v("high")), " euros. The range is a 90% nominal interval that covered ",
                 pct1(v("interval_test_coverage")), "% of held-out test properties when measured.")
    drivers = _cat("Value drivers (SHAP): ", v("driver_text"))
    listed = F.transform(c("items"), lambda x: _cat(
        "Comparable ", x["rank"].cast("string"), ": listed at ", format_eur(x["price"]), " euros, ", x["why"],
        " (listing ", x["asset_id"], ")."))
    comp_sum = _cat("The ", c("n").cast("string"), " comparables list between ", format_eur(c("price_min")), " and ",
                    format_eur(c("price_max")), " euros with a median of ", format_eur(c("price_median")),
                    " euros; the farthest is ", fixed(c("max_distance_km"), 2), " km from the subject.")
    comp_facts = F.when(F.col("comps").isNotNull(), F.concat(listed, F.array(comp_sum))).otherwise(
        F.array(F.lit(NO_COMPS)))
    year_part = F.when(e("effective_year").isNotNull(), _cat("built ", e("effective_year").cast("string"))).otherwise(
        "new-build condition")
    band = F.when(e("band") == "unknown", UNKNOWN_BAND).otherwise(_cat(
        "Energy: EPC band ", e("band"), " proxy, derived from building age and condition (", year_part,
        "), not a certificate."))
    gap = F.when(F.col("energy.impact").isNotNull(), _cat(
        "In ", imp("scope"), ", pre-1980 stock lists at a median of ", format_eur(imp("median_old_eur_m2")),
        " euros per m2 and post-2006 stock at ", format_eur(imp("median_new_eur_m2")), " euros per m2 (",
        format_eur(imp("n_old")), " and ", format_eur(imp("n_new")), " listings with a known build year). "
        "Applied to this property's ", imp("subject_area_m2").cast("string"), " m2, post-2006 stock lists ",
        format_eur(F.abs(imp("subject_gap_eur"))), " euros ",
        F.when(imp("gap_eur_m2") < 0, "lower").otherwise("higher"), ". " + ENERGY_DISCLAIMER))
    energy_facts = F.when(F.col("energy").isNotNull(), F.array_compact(F.array(
        band, F.when(e("flag"), RISK_FLAG), gap))).otherwise(F.array(F.lit(NO_ENERGY)))
    return F.when(F.col("valuation").isNotNull(), F.concat(
        F.array(subject, value, drivers), comp_facts, energy_facts, F.array(F.lit(CAVEAT))))


def required_items() -> Column:
    return F.when(F.col("valuation").isNotNull(), F.array_compact(F.array(
        format_eur(F.col("valuation.estimate")), format_eur(F.col("valuation.low")),
        format_eur(F.col("valuation.high")), pct1(F.col("valuation.interval_test_coverage")), F.lit(CAVEAT),
        F.when(F.col("energy").isNotNull(), "proxy"),
        F.when(F.col("energy.impact").isNotNull(), ENERGY_DISCLAIMER))))


def prompt_text(facts: Column, required: Column) -> Column:
    """The prompt as a data column, for whoever runs a model elsewhere."""
    verbatim = F.transform(F.filter(required, lambda r: F.length(r) > VERBATIM_MIN),
                           lambda r: _cat('- "', r, '"'))
    return _cat(PROMPT_HEAD, F.array_join(verbatim, "\n"), PROMPT_MID,
                F.array_join(F.transform(facts, lambda f: _cat("- ", f)), "\n"), "\n")


def narrative(cases: DataFrame, candidate: str | None = None, backend: str = "model") -> DataFrame:
    """Adds facts, required, narrative, narrative_source and the note appended to errors.

    A candidate text is used when it passes every check, else the template is, with the
    reasons noted. No valuation, no text. The template runs through the same checks and
    stops the job if it ever fails them.
    """
    d = cases.withColumn("facts", build_facts()).withColumn("required", required_items())
    d = d.withColumn("facts_text", F.array_join("facts", "\n"))
    template = _cat(TEMPLATE_LABEL + "\n", F.array_join("facts", " "))
    d = d.withColumn("_template", template)
    bad = validate_text(F.col("_template"), F.col("facts_text"), F.col("required"))
    d = d.withColumn("_template", F.when(F.col("valuation").isNull(), F.lit(None).cast("string")).when(
        F.size(bad) == 0, F.col("_template")).otherwise(F.raise_error(_cat(
            "template narrative failed its own validation: ", F.array_join(bad, "; ")))))
    has = F.lit(False)
    d = d.withColumn("_problems", F.array().cast("array<string>"))
    if candidate is not None:
        d = d.withColumn("_problems", F.coalesce(validate_text(
            F.col(candidate), F.col("facts_text"), F.col("required")), F.array().cast("array<string>")))
        has = F.col(candidate).isNotNull()
    missing, ok = F.col("valuation").isNull(), has & (F.size("_problems") == 0)
    text = F.when(missing, F.lit(None).cast("string"))
    if candidate is not None:
        text = text.when(ok, F.col(candidate))
    note = (F.when(missing, NO_VALUATION_NOTE).when(ok, F.lit(None).cast("string"))
            .when(has, _cat(f"narrative_agent: {backend} output rejected (", F.array_join("_problems", "; "),
                            "), template fallback used")).otherwise(NO_BACKEND_NOTE))
    return (d.withColumn("narrative", text.otherwise(F.col("_template")))
            .withColumn("narrative_source", F.when(missing, "failed").when(ok, f"llm:{backend}").otherwise("template"))
            .withColumn("errors", F.concat("errors", F.array_compact(F.array(note))))
            .withColumn("facts_text", F.when(~missing, F.col("facts_text"))).drop("_template", "_problems"))


def payload(cases: DataFrame, k: int = comps_op.TOP_K) -> DataFrame:
    """subject_id, envelope struct, error, JSON. Fail-closed: without drivers or without a
    band the row carries an error and no number at all."""
    v = F.col("valuation")
    ok = v.isNotNull() & (F.size("valuation.top_drivers") > 0) & v["low"].isNotNull() & v["high"].isNotNull()
    estimate = F.struct(*[v[f].alias(f) for f in (
        "estimate", "low", "high", "interval_coverage", "interval_test_coverage", "top_drivers", "driver_text")])
    comparables = F.when(F.col("comps").isNotNull(), F.struct(
        F.lit(comps_op.method_text(k)).alias("method"), *[F.col(f"comps.{f}").alias(f) for f in (
            "n", "items", "price_min", "price_max", "price_median", "max_distance_km")],
        F.col("latitude").alias("subject_latitude"), F.col("longitude").alias("subject_longitude")))
    energy = F.when(F.col("energy").isNotNull(), F.struct(
        *[F.col(f"energy.{f}").alias(f) for f in ("band", "band_is_proxy", "flag", "effective_year", "year_source", "impact")],
        F.lit(ENERGY_DISCLAIMER).alias("energy_disclaimer")))
    envelope = F.when(ok, F.struct(F.lit(CAVEAT).alias("caveat"), F.col("subject_id").alias("asset_id"),
                                   estimate.alias("estimate"), comparables.alias("comparables"), energy.alias("energy")))
    out = cases.select("subject_id", envelope.alias("payload"), F.when(
        ~ok, "No confidence range or SHAP drivers available for this property. No estimate is shown.").alias("error"))
    failed = F.struct(F.struct(F.lit("valuation_failed").alias("type"), F.col("error").alias("message")).alias("error"))
    return out.withColumn("json", F.coalesce(F.to_json("payload"), F.to_json(failed)))


def marker_pct(estimate: Column, low: Column, high: Column) -> Column:
    """Where the estimate lies in the band, 0 to 100; the middle for an empty band."""
    span = high - low
    return F.when(span > 0, F.least(F.greatest(F.try_divide(estimate - low, span) * 100, F.lit(0.0)),
                                    F.lit(100.0))).otherwise(50.0)
