"""Reports, narratives and text checks as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.functions import text
from estate_spark.operators import curate, report, valuation
from estate_spark.plans.base_sql import on_listings, on_split
from estate_spark.plans.modelling import DRIVERS, LINEAR, TRAIN, bundle, explained
from estate_spark.plans.neighbours import BAND, COMPS, GAP, PAIRS, all_comps, subjects
from estate_spark.plans.registry import query
from estate_spark.plans.sampling import split
from estate_spark.session import grown, once, written
from estate_spark.sources import io

LF = "chr(10)"


# ---------------------------------------------------------------- texts at volume
def documents(spark, sf):
    return io.read_table(spark, sf, "documents")


def _joined(arr):
    return F.array_join(F.array_sort(arr), ",")


_NUM = r"(^|[^A-Za-z0-9])(\d+(?:,\d{3})*(?:\.\d+)?)"


def _nums(expr: str) -> str:
    found = f"regexp_extract_all({expr}, '{_NUM}', 2)"
    return (f"CASE WHEN len({found}) = 0 THEN CAST([] AS VARCHAR[]) ELSE "
            f"list_distinct(string_split(replace(array_to_string({found}, '|'), ',', ''), '|')) END")


@query("extract_numbers", f"SELECT doc_id, coalesce(array_to_string(list_sort({_nums('text')}), ','), '') AS numbers FROM documents")
def extract_numbers(spark, sf):
    return documents(spark, sf).select("doc_id", _joined(text.extract_numbers(F.col("text"))).alias("numbers"))


_META = "concat(source, ' ', CAST(doc_id AS VARCHAR), ' ', CAST(n_chars AS VARCHAR))"


@query("stray_numbers", f"""SELECT doc_id, coalesce(string_agg(n, ',' ORDER BY n), '') AS stray FROM documents LEFT JOIN (
    SELECT doc_id AS d, unnest({_nums('text')}) AS n, {_nums(_META)} AS known FROM documents) q ON d = doc_id AND NOT list_contains(known, n) GROUP BY 1""")
def stray_numbers(spark, sf):
    facts = F.concat("source", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" "), F.col("n_chars").cast("string"))
    return documents(spark, sf).select("doc_id", F.array_join(text.stray_numbers(F.col("text"), facts), ",").alias("stray"))


def _word_sql(col: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({col}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){w}') THEN 'contains banned word ''{w}''' END"
                     for w in text.BANNED_WORDS)


def _char_sql(col: str) -> str:
    return ", ".join(f"CASE WHEN contains({col}, '{ch}') THEN 'contains a {name}' END" for ch, name in text.FORBIDDEN_CHARS)


@query("banned_words", f"SELECT doc_id, concat_ws('; ', {_word_sql('text')}) AS problems FROM documents")
def banned_words(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(text.word_problems(F.col("text")), "; ").alias("problems"))


@query("forbidden_chars", f"""SELECT doc_id, concat_ws('; ', {_char_sql('text')}) AS problems FROM documents
    UNION ALL SELECT -1 - page_id, concat_ws('; ', {_char_sql('html')}) FROM pages""")
def forbidden_chars(spark, sf):
    d = documents(spark, sf).select("doc_id", F.array_join(text.char_problems(F.col("text")), "; ").alias("problems"))
    p = io.read_table(spark, sf, "pages").select((F.lit(-1) - F.col("page_id")).alias("doc_id"), F.array_join(
        text.char_problems(F.col("html")), "; ").alias("problems"))
    return d.unionByName(p)


@query("required_text", """SELECT doc_id, concat_ws('; ', CASE WHEN NOT contains(text, lang) THEN concat('missing required text ''', lang, '''') END,
    CASE WHEN NOT contains(text, source) THEN concat('missing required text ''', source, '''') END,
    CASE WHEN NOT contains(text, 'the') THEN 'missing required text ''the''' END) AS problems FROM documents""")
def required_text(spark, sf):
    need = F.array("lang", "source", F.lit("the"))
    return documents(spark, sf).select("doc_id", F.array_join(text.missing_problems(F.col("text"), need), "; ").alias("problems"))


# ---------------------------------------------------------------- number formats
@query("format_eur", on_listings("SELECT asset_id, format('{:,.0f}', price) AS price_text, format('{:,.0f}', unit_price_m2) AS unit_text FROM listings"))
def format_eur(spark, sf):
    return curate.curated(spark, sf).select("asset_id", text.format_eur(F.col("price")).alias("price_text"),
                                            text.format_eur(F.col("unit_price_m2")).alias("unit_text"))


@query("pct_format", on_listings("""SELECT asset_id, format('{:.1f}', distance_to_metro / 8 * 100) AS pct1, format('{:.0f}', distance_to_metro / 8 * 100) AS pct0 FROM listings"""))
def pct_format(spark, sf):
    share = F.col("distance_to_metro") / 8
    return curate.curated(spark, sf).select("asset_id", text.pct1(share).alias("pct1"), text.pct0(share).alias("pct0"))


@query("plural_s", on_listings("""SELECT asset_id, concat(CAST(rooms AS VARCHAR), ' room', CASE WHEN rooms <> 1 THEN 's' ELSE '' END) AS rooms_text FROM listings"""))
def plural_s(spark, sf):
    return curate.curated(spark, sf).select("asset_id", F.concat(
        F.col("rooms").cast("string"), F.lit(" room"), text.plural_s(F.col("rooms"))).alias("rooms_text"))


# ---------------------------------------------------------------- cases
VAL = [("val_errors", """SELECT e, row_number() OVER (ORDER BY e) AS k, count(*) OVER () AS n FROM (
          SELECT abs(price - prediction) AS e FROM linear t JOIN listings l ON l.asset_id = t.asset_id JOIN split s ON s.asset_id = t.asset_id WHERE split = 'val') q"""),
       ("half_width", "SELECT e AS q FROM val_errors WHERE k = least(CAST(ceil((n + 1) * (0.95::DOUBLE - 0.05::DOUBLE)) AS BIGINT), n)"),
       ("banded", "SELECT asset_id AS subject_id, prediction AS estimate, prediction - q AS low, prediction + q AS high, driver_text FROM driver_texts, half_width"),
       ("measured", """SELECT avg(CASE WHEN price BETWEEN low AND high THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS covered FROM banded b
          JOIN listings l ON l.asset_id = b.subject_id JOIN split s ON s.asset_id = b.subject_id WHERE split = 'test'"""),
       ("vals", "SELECT *, format('{:.1f}', covered * 100) AS covered_pct FROM banded, measured")]
CASE = [("comp_agg", """SELECT subject_id, count(*) AS n, min(price) AS price_min, max(price) AS price_max, quantile_cont(price, 0.5) AS price_median,
          max(distance_km) AS max_distance_km, string_agg(concat('Comparable ', CAST(rank AS VARCHAR), ': listed at ', format('{:,.0f}', price), ' euros, ', why, ' (listing ', asset_id, ').'), """ + LF + """ ORDER BY rank) AS lines
          FROM comps GROUP BY 1"""),
        ("cases", """SELECT l.*, l.asset_id AS subject_id, v.estimate, v.low, v.high, v.covered_pct, v.driver_text, v.subject_id IS NOT NULL AS has_v, a.n, a.price_min, a.price_max, a.price_median,
          a.max_distance_km, a.lines, a.subject_id IS NOT NULL AS has_c, b.subject_id IS NOT NULL AS has_e, b.band, b.flag, b.effective_year,
          g.scope, g.n_old, g.n_new, g.median_old_eur_m2, g.median_new_eur_m2, g.gap_eur_m2, g.subject_area_m2, g.subject_gap_eur
          FROM listings l LEFT JOIN vals v ON v.subject_id = l.asset_id LEFT JOIN comp_agg a ON a.subject_id = l.asset_id
          LEFT JOIN band b ON b.subject_id = l.asset_id LEFT JOIN gap g ON g.subject_id = l.asset_id""")]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ERR = f"""concat_ws('; ', CASE WHEN NOT has_c THEN concat('comparables_agent: no listings share property_type ''', property_type, '''') END,
    CASE WHEN NOT has_v THEN concat('valuation_agent: no valuation for ', subject_id) END, CASE WHEN NOT has_e THEN concat('energy_agent: no assessment for ', subject_id) END)"""


def _facts_sql(sep: str) -> str:
    return f"""concat_ws({sep},
    concat('Subject property: a ', property_type, ' in ', coalesce(neighborhood_name, {_q(report.NO_ZONE)}), ', ', format('{{:.0f}}', area_m2), ' m2, ', CAST(rooms AS VARCHAR), ' room',
      CASE WHEN rooms <> 1 THEN 's' ELSE '' END, ', ', CAST(bathrooms AS VARCHAR), ' bathroom', CASE WHEN bathrooms <> 1 THEN 's' ELSE '' END, ', condition ', condition, '.'),
    concat('Estimated market value: ', format('{{:,.0f}}', estimate), ' euros, in a range of ', format('{{:,.0f}}', low), ' to ', format('{{:,.0f}}', high),
      ' euros. The range is a 90% nominal interval that covered ', covered_pct, '% of held-out test properties when measured.'),
    concat('Value drivers (SHAP): ', driver_text),
    CASE WHEN has_c THEN replace(lines, {LF}, {sep}) ELSE {_q(report.NO_COMPS)} END,
    CASE WHEN has_c THEN concat('The ', CAST(n AS VARCHAR), ' comparables list between ', format('{{:,.0f}}', price_min), ' and ', format('{{:,.0f}}', price_max), ' euros with a median of ',
      format('{{:,.0f}}', price_median), ' euros; the farthest is ', format('{{:.2f}}', max_distance_km), ' km from the subject.') END,
    CASE WHEN NOT has_e THEN {_q(report.NO_ENERGY)} WHEN band = 'unknown' THEN {_q(report.UNKNOWN_BAND)}
      ELSE concat('Energy: EPC band ', band, ' proxy, derived from building age and condition (', CASE WHEN effective_year IS NOT NULL THEN concat('built ', CAST(effective_year AS VARCHAR)) ELSE 'new-build condition' END, '), not a certificate.') END,
    CASE WHEN has_e AND flag THEN {_q(report.RISK_FLAG)} END,
    CASE WHEN has_e AND scope IS NOT NULL THEN concat('In ', scope, ', pre-1980 stock lists at a median of ', format('{{:,}}', median_old_eur_m2), ' euros per m2 and post-2006 stock at ',
      format('{{:,}}', median_new_eur_m2), ' euros per m2 (', format('{{:,}}', n_old), ' and ', format('{{:,}}', n_new), ' listings with a known build year). Applied to this property''s ',
      CAST(subject_area_m2 AS VARCHAR), ' m2, post-2006 stock lists ', format('{{:,}}', abs(subject_gap_eur)), ' euros ', CASE WHEN gap_eur_m2 < 0 THEN 'lower' ELSE 'higher' END, {_q('. ' + report.ENERGY_DISCLAIMER)}) END,
    {_q(report.CAVEAT)})"""


_REQ = f"""concat_ws('|', format('{{:,.0f}}', estimate), format('{{:,.0f}}', low), format('{{:,.0f}}', high), covered_pct, {_q(report.CAVEAT)}, CASE WHEN has_e THEN 'proxy' END,
    CASE WHEN has_e AND scope IS NOT NULL THEN {_q(report.ENERGY_DISCLAIMER)} END)"""
ALL = [TRAIN, *LINEAR, *DRIVERS, PAIRS, COMPS, BAND, *GAP, *VAL, *CASE]


def on_cases(sql: str) -> str:
    return on_split(sql, *ALL)


def cases(spark, sf):
    """Every listing as a subject, with the linear model's valuation."""
    def build():
        listings = curate.curated(spark, sf)
        points = valuation.priced(explained(spark, sf), listings, split(spark, sf)).withColumnRenamed("asset_id", "subject_id")
        val = valuation.conformal(points.drop("base_value"), C.TARGET)
        return written(valuation.cases(subjects(spark, sf), listings, val, all_comps(spark, sf)), "cases")
    return once(spark, ("cases", sf), build)


@query("branch_fan_in", on_cases(f"SELECT subject_id, round(estimate, 6) AS estimate, n AS n_comps, CASE WHEN has_e THEN band END AS band, {_ERR} AS errors FROM cases"))
def branch_fan_in(spark, sf):
    return cases(spark, sf).select("subject_id", F.round("valuation.estimate", 6).alias("estimate"), F.col("comps.n").alias("n_comps"),
                                   F.col("energy.band").alias("band"), F.array_join("errors", "; ").alias("errors"))


@query("build_facts", on_cases(f"SELECT subject_id, CASE WHEN has_v THEN {_facts_sql(LF)} END AS facts FROM cases"))
def build_facts(spark, sf):
    return cases(spark, sf).select("subject_id", F.array_join(report.build_facts(), "\n").alias("facts"))


@query("required_items", on_cases(f"SELECT subject_id, CASE WHEN has_v THEN {_REQ} END AS required FROM cases"))
def required_items(spark, sf):
    return cases(spark, sf).select("subject_id", F.array_join(report.required_items(), "|").alias("required"))


_FACTS_DASH = f"concat('- ', replace({_facts_sql(LF)}, {LF}, concat({LF}, '- ')))"
_VERB = f"""concat_ws({LF}, concat('- "', {_q(report.CAVEAT)}, '"'), CASE WHEN has_e AND scope IS NOT NULL THEN concat('- "', {_q(report.ENERGY_DISCLAIMER)}, '"') END)"""


@query("prompt_rows", on_cases(f"""SELECT subject_id, CASE WHEN has_v THEN concat({_q(report.PROMPT_HEAD)}, {_VERB}, {_q(report.PROMPT_MID)}, {_FACTS_DASH}, {LF}) END AS prompt FROM cases"""))
def prompt_rows(spark, sf):
    c = cases(spark, sf).withColumn("facts", report.build_facts()).withColumn("required", report.required_items())
    return c.select("subject_id", report.prompt_text(F.col("facts"), F.col("required")).alias("prompt"))


# candidate texts: one third exact facts, one third with a number nobody computed and a banned
# word, one third none
def candidate():
    turn = F.pmod(F.substring("subject_id", 2, 20).cast("bigint"), F.lit(3))
    facts = F.array_join(report.build_facts(), " ")
    return F.when(turn == 0, facts).when(turn == 1, F.concat(facts, F.lit(" A robust 999,731 more.")))


_TURN = "CAST(substr(subject_id, 2) AS BIGINT) % 3"
_BAD = "contains banned word ''robust''; numbers not present in the facts: [''999731'']"


@query("validate_text", on_cases(f"""SELECT subject_id, CASE WHEN has_v THEN CASE {_TURN} WHEN 0 THEN '' WHEN 1 THEN '{_BAD}' END END AS problems FROM cases"""))
def validate_text(spark, sf):
    c = (cases(spark, sf).withColumn("facts", F.array_join(report.build_facts(), "\n"))
         .withColumn("required", report.required_items()).withColumn("candidate", candidate()))
    return c.select("subject_id", F.array_join(text.validate_text(F.col("candidate"), F.col("facts"), F.col("required")), "; ").alias("problems"))


@query("narrative_template", on_cases(f"""SELECT subject_id, CASE WHEN NOT has_v THEN NULL WHEN {_TURN} = 0 THEN {_facts_sql("' '")}
      ELSE concat({_q(report.TEMPLATE_LABEL)}, {LF}, {_facts_sql("' '")}) END AS narrative,
    CASE WHEN NOT has_v THEN 'failed' WHEN {_TURN} = 0 THEN 'llm:model' ELSE 'template' END AS narrative_source,
    concat_ws('; ', nullif({_ERR}, ''), CASE WHEN NOT has_v THEN {_q(report.NO_VALUATION_NOTE)} WHEN {_TURN} = 0 THEN NULL
      WHEN {_TURN} = 1 THEN 'narrative_agent: model output rejected ({_BAD}), template fallback used' ELSE {_q(report.NO_BACKEND_NOTE)} END) AS errors FROM cases"""))
def narrative_template(spark, sf):
    c = cases(spark, sf).withColumn("candidate", candidate())
    return report.narrative(c, "candidate").select("subject_id", "narrative", "narrative_source", F.array_join("errors", "; ").alias("errors"))


@query("valuation_payload", on_cases(f"""SELECT subject_id, CASE WHEN has_v THEN {_q(report.CAVEAT)} END AS caveat, round(estimate, 6) AS estimate, round(low, 6) AS low, round(high, 6) AS high,
    (SELECT feature FROM drivers d WHERE d.asset_id = subject_id AND place = 1 AND has_v) AS first_driver, CASE WHEN has_v THEN n END AS n_comps,
    CASE WHEN has_v AND has_e THEN band END AS band, CASE WHEN has_v AND has_e THEN scope END AS scope,
    CASE WHEN NOT has_v THEN 'No confidence range or SHAP drivers available for this property. No estimate is shown.' END AS error FROM cases"""))
def valuation_payload(spark, sf):
    p = report.payload(cases(spark, sf))
    return p.select("subject_id", F.col("payload.caveat").alias("caveat"), *[
        F.round(f"payload.estimate.{c}", 6).alias(c) for c in ("estimate", "low", "high")],
        F.col("payload.estimate.top_drivers")[0]["feature"].alias("first_driver"), F.col("payload.comparables.n").alias("n_comps"),
        F.col("payload.energy.band").alias("band"), F.col("payload.energy.impact.scope").alias("scope"), "error")


@query("bundle_reports")
def bundle_reports(spark, sf):
    """The whole chain on the trained bundle: scores, drivers, comparables, energy, texts, payload."""
    def build():
        s = subjects(spark, sf)
        return written(valuation.cases(s, curate.curated(spark, sf), valuation.by_bundle(s, bundle(spark, sf)), all_comps(spark, sf)), "bundle-cases")
    told = report.narrative(once(spark, ("bundle-cases", sf), build))
    out = report.payload(told).select("subject_id", "payload", "error", "json")
    return told.select("subject_id", "narrative", "narrative_source", F.array_join("errors", "; ").alias("errors")).join(grown(out), "subject_id").select(
        "subject_id", *[F.col(f"payload.estimate.{c}").alias(c) for c in ("estimate", "low", "high", "interval_test_coverage")],
        F.col("payload.comparables.n").alias("n_comps"), F.col("payload.energy.band").alias("band"), "narrative", "narrative_source", "errors", "error", "json")


@query("marker_pct", on_listings("""SELECT asset_id, CASE WHEN hi - lo > 0 THEN round(least(greatest((e - lo) / (hi - lo) * 100, 0), 100), 6) ELSE 50.0::DOUBLE END AS marker
    FROM (SELECT asset_id, 2500::DOUBLE * area_m2 AS e, price * 0.8::DOUBLE AS lo, CASE WHEN rooms = 1 THEN price * 0.8::DOUBLE ELSE price * 1.3::DOUBLE END AS hi FROM listings) q"""))
def marker_pct(spark, sf):
    lo = F.col("price") * 0.8
    hi = F.when(F.col("rooms") == 1, lo).otherwise(F.col("price") * 1.3)
    return curate.curated(spark, sf).select("asset_id", F.round(report.marker_pct(F.lit(2500.0) * F.col("area_m2"), lo, hi), 6).alias("marker"))
