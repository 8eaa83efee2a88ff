"""Input drift between two frames: PSI and the two-sample Kolmogorov-Smirnov test.

All of it is computed from one state, the number of reference and of current rows per feature
and value. States add up: those of batches merge to that of all their rows, so a stream can
add each batch's counts to a folder and read the drift of everything seen so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark import contract as C
from estate_spark.functions.text import fixed
from estate_spark.operators import ranks
from estate_spark.session import written

# fixed values
PSI_FLAG, PSI_BINS, PSI_FLOOR = 0.2, 10, 1e-6
NOTE = ("Input drift only. Label drift is not measurable: the reference data is static 2018 "
        "asking prices with no live sale feed.")


def numeric_features(reference: DataFrame, current: DataFrame) -> list[str]:
    """Numeric model inputs present in both frames and not all null in the reference."""
    names = [c for c in C.numeric_candidates() if c in reference.columns]
    row = reference.agg(*[F.count(c).alias(c) for c in names]).first()
    return [c for c in names if row[c] > 0 and c in current.columns]


def state(reference: DataFrame | None, current: DataFrame | None, cols: list[str]) -> DataFrame:
    """series, value, ref, cur: rows of each side per feature and value; one pass a side."""
    out = None
    for df, ref in ((reference, 1), (current, 0)):
        if df is not None:
            side = ranks.long_format(df, cols, []).select("series", "value", F.lit(ref).alias("ref"), F.lit(1 - ref).alias("cur"))
            out = side if out is None else out.unionByName(side)
    return merged(out)


def merged(states: DataFrame) -> DataFrame:
    """The state of all rows that the given states count."""
    return states.groupBy("series", "value").agg(F.sum("ref").cast("bigint").alias("ref"), F.sum("cur").cast("bigint").alias("cur"))


def add_batch(batch: DataFrame, batch_id: int, folder: str, cols: list[str], side: str = "cur") -> None:
    """Store the counts of one batch; the same batch again replaces itself, so this can be a
    stream's foreachBatch."""
    one = state(batch, None, cols) if side == "ref" else state(None, batch, cols)
    one.write.mode("overwrite").parquet(f"{folder}/side={side}/batch={batch_id}")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """The merged state of all batches in a folder."""
    stored = spark.read.schema("series string, value double, ref long, cur long, side string, batch string").parquet(folder)
    return merged(stored.drop("side", "batch"))


def ranked(counts: DataFrame, small: bool | None = None) -> DataFrame:
    """A state with the running and total counts of both sides, written once for all readers."""
    counts = written(counts, "drift-state")
    return written(ranks.running_counts(counts, [], ["ref", "cur"], ranks.is_small(counts) if small is None else small), "drift-ranks")


def ref_quantiles(r: DataFrame, qs: list[float]) -> DataFrame:
    """series, q: the reference's quantiles, interpolated between the rows next to (n-1)q."""
    start, end = F.col("ref_before"), F.col("ref_before") + F.col("ref")

    def at(rank: Column) -> Column:
        return F.max(F.when((start <= rank) & (rank < end), F.col("value")))

    pos = [(F.col("ref_total") - 1) * F.lit(float(q)) for q in qs]
    found = r.filter("ref > 0").groupBy("series", "ref_total").agg(*[
        at(g(p)).alias(f"{n}{i}") for i, p in enumerate(pos) for n, g in (("lo", F.floor), ("hi", F.ceil))])
    steps = []
    for i, p in enumerate(pos):
        share = p - F.floor(p)
        # between equal values the weighted sum may miss them by a bit and move a whole value to the next bin
        steps.append(F.when((share == 0) | (F.col(f"lo{i}") == F.col(f"hi{i}")), F.col(f"lo{i}")).otherwise(F.col(f"lo{i}") * (1 - share) + F.col(f"hi{i}") * share))
    return found.select("series", F.array(*steps).alias("q"))


def psi_term(ref_share: Column, cur_share: Column) -> Column:
    r, c = F.greatest(ref_share, F.lit(PSI_FLOOR)), F.greatest(cur_share, F.lit(PSI_FLOOR))
    return (c - r) * F.ln(c / r)


def psi_bins(r: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """series, n_edges, bin, n_ref, n_cur over the reference's quantile bins, empty bins included."""
    # at most bins+1 edges per contract column
    edges = ref_quantiles(r, [i / bins for i in range(bins + 1)]).select("series", F.array_sort(F.array_distinct("q")).alias("e"))
    table = written(edges.select("series", F.size("e").alias("n_edges"), F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("inner")), "drift-edges")
    placed = r.join(F.broadcast(table), "series").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    counts = placed.groupBy("series", "bin").agg(F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"))
    grid = table.select("series", "n_edges", F.explode(
        F.sequence(F.lit(0), F.greatest(F.col("n_edges") - 2, F.lit(0)))).alias("bin"))
    return grid.join(counts, ["series", "bin"], "left").fillna(0, ["n_ref", "n_cur"])


def psi(reference: DataFrame, current: DataFrame, cols: list[str], bins: int = PSI_BINS,
        small: bool | None = None) -> DataFrame:
    """feature, psi: 0 with fewer than two distinct edges, NaN when a side is empty."""
    return psi_of(ranked(state(reference, current, cols), small), cols, bins)


def psi_of(r: DataFrame, cols: list[str], bins: int = PSI_BINS) -> DataFrame:
    b = psi_bins(r, bins)
    w = Window.partitionBy("series")        # as many rows as bins
    terms = b.select("*", F.sum("n_ref").over(w).alias("t_ref"), F.sum("n_cur").over(w).alias("t_cur"))
    terms = terms.withColumn("term", psi_term(
        F.try_divide(F.col("n_ref").cast("double"), F.col("t_ref")),
        F.try_divide(F.col("n_cur").cast("double"), F.col("t_cur"))))
    out = terms.groupBy("series").agg(F.sum("term").alias("s"), F.max("n_edges").alias("e"), F.max("t_ref").alias("r"),
                                      F.max("t_cur").alias("c"))
    out = out.select(F.col("series").alias("feature"),
                     F.when((F.col("r") == 0) | (F.col("c") == 0), float("nan")).when(F.col("e") < 2, 0.0)
                     .otherwise(F.col("s")).alias("psi"))
    return _every(out, cols, ["psi"])


def _every(df: DataFrame, cols: list[str], values: list[str]) -> DataFrame:
    """One row per requested feature, NaN where a feature had no value at all."""
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(df, "feature", "left").select("feature", *[
        F.coalesce(v, F.lit(float("nan"))).alias(v) for v in values])


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value, 2 sum (-1)^(j-1) exp(-2 j^2 t^2) with
    t = D sqrt(n1 n2 / (n1 + n2)); 1 for tiny t, where the series does not settle."""
    t2 = d * d * (n1.cast("double") * n2) / (n1 + n2)
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0)
                        * F.exp(F.lit(-2.0) * j * j * t2))
    p = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(t2 < 0.04, 1.0).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def ecdf(reference: DataFrame, current: DataFrame, cols: list[str], small: bool | None = None) -> DataFrame:
    """series, value, and both cumulative shares at every distinct value."""
    return ecdf_of(ranked(state(reference, current, cols), small))


def ecdf_of(r: DataFrame) -> DataFrame:
    return r.select("series", "value", F.col("ref_total").alias("n_ref"), F.col("cur_total").alias("n_cur"),
                    F.try_divide((F.col("ref_before") + F.col("ref")).cast("double"), F.col("ref_total")).alias("cdf_ref"),
                    F.try_divide((F.col("cur_before") + F.col("cur")).cast("double"), F.col("cur_total")).alias("cdf_cur"))


def ks(reference: DataFrame, current: DataFrame, cols: list[str], small: bool | None = None) -> DataFrame:
    """feature, ks_statistic, ks_p_value (NaN when a side has no value)."""
    return ks_of(ranked(state(reference, current, cols), small), cols)


def ks_of(r: DataFrame, cols: list[str]) -> DataFrame:
    d = ecdf_of(r).groupBy("series").agg(F.max(F.abs(F.col("cdf_ref") - F.col("cdf_cur"))).alias("d"),
                                         F.max("n_ref").alias("n1"), F.max("n_cur").alias("n2"))
    out = d.select(F.col("series").alias("feature"), F.col("d").alias("ks_statistic"),
                   kolmogorov_p(F.col("d"), F.col("n1"), F.col("n2")).alias("ks_p_value"))
    return _every(out, cols, ["ks_statistic", "ks_p_value"])


def drift_table(reference: DataFrame, current: DataFrame, small: bool | None = None) -> DataFrame:
    """feature, psi, ks_statistic, ks_p_value, drifted. A pure function of two frames; each is
    read once for the state. NaN never counts as drift."""
    cols = numeric_features(reference, current)
    return drift_of(state(reference, current, cols), cols, small)


def drift_of(counts: DataFrame, cols: list[str], small: bool | None = None) -> DataFrame:
    """The drift table of a state, whatever batches it was merged from."""
    r = ranked(counts, small)
    both = psi_of(r, cols).join(ks_of(r, cols), "feature")
    return both.withColumn("drifted", ~F.isnan("psi") & (F.col("psi") > PSI_FLAG))


def drift_summary(table: DataFrame, reference: DataFrame, current: DataFrame) -> DataFrame:
    """One row: sizes, threshold, drifted features (sorted), any_drift, note."""
    return table.agg(F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
                     F.bool_or("drifted").alias("any_drift")).select(
        reference.agg(F.count("*")).scalar().alias("n_reference"), current.agg(F.count("*")).scalar().alias("n_current"),
        F.lit(PSI_FLAG).alias("psi_threshold"), "drifted_features", "any_drift", F.lit(NOTE).alias("note"))


def general_4(x: Column) -> Column:
    """Four significant digits without trailing zeros; scientific below 1e-4."""
    exp10 = F.floor(F.log10(x))
    text = fixed(x, 3)
    for digits in range(4, 8):
        text = F.when(exp10 == 3 - digits, fixed(x, digits)).otherwise(text)
    plain = F.regexp_replace(text, r"\.?0+$", "")
    sci = F.call_function("format_number", x, F.lit("0.###E0"))
    power = F.regexp_extract(sci, r"E-(\d+)$", 1)
    sci = F.concat(F.regexp_extract(sci, r"^([0-9.]+)E", 1), F.lit("e-"), F.lpad(power, 2, "0"))
    return F.when(F.isnan(x), "nan").when(x == 0, "0").when(x < 1e-4, sci).otherwise(plain)


def report_lines(table: DataFrame, summary: DataFrame) -> DataFrame:
    """line_no, line: the report as Markdown rows; one row per feature plus a fixed frame."""
    head = summary.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("line_no"), c.alias("line")) for i, c in enumerate([
            F.lit("# Input-drift report"), F.lit(""), F.col("note"), F.lit(""),
            F.concat(F.lit("Reference rows: "), F.col("n_reference").cast("string"), F.lit("  Current rows: "),
                     F.col("n_current").cast("string")),
            F.concat(F.lit("PSI flag threshold: "), F.col("psi_threshold").cast("string")), F.lit(""),
            F.lit("| feature | psi | ks_statistic | ks_p_value | drifted |"), F.lit("|---|---|---|---|---|")])] + [
        F.struct(F.lit(1000).alias("line_no"), F.lit("").alias("line")),
        F.struct(F.lit(1001).alias("line_no"), F.when(F.col("any_drift"), F.concat(
            F.lit("Drifted features: "), F.array_join("drifted_features", ", "))).otherwise(
            "No feature crossed the PSI threshold.").alias("line"))])).alias("r")).select("r.*")
    order = {c: 9 + i for i, c in enumerate(C.numeric_candidates())}
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    body = table.select(pos[F.col("feature")].alias("line_no"), F.concat(
        F.lit("| "), F.col("feature"), F.lit(" | "), fixed(F.col("psi"), 4), F.lit(" | "), fixed(F.col("ks_statistic"), 4),
        F.lit(" | "), general_4(F.col("ks_p_value")), F.lit(" | "), F.initcap(F.col("drifted").cast("string")),
        F.lit(" |")).alias("line"))
    return head.unionByName(body)


def report_json(table: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON row: the summary with the per-feature list nested in it."""
    rows = table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias("features"))
    return summary.withColumn("features", rows.scalar()).select(F.to_json(F.struct("*")).alias("value"))
