"""Headline queries, wall seconds each; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select the data and
the cores. Stage tables (curated listings, split, models) are built once and timed as their
own entries, as the pipeline itself builds them once; every query is then run twice and the
faster run counts. Results are written to Spark's no-op sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "scan_pruned", "dedupe_latest", "hard_validity", "outlier_trim", "pip_join", "group_medians",
    "group_median_all", "kpi_delta", "histogram", "topn_groups", "nearest_to_quantile", "default_fill",
    "expectations", "split_3way", "stratified_sample", "join_left_attach", "comparables", "comps_summary",
    "segment_gap", "cqr_calibrate", "band_apply", "regression_metrics", "auc", "psi", "ks_2samp",
    "drift_table", "score_batch", "shap_rows", "top_drivers", "global_importance", "build_facts",
    "narrative_template", "valuation_payload", "extract_numbers", "banned_words",
]


def session() -> SparkSession:
    return (SparkSession.builder.master(f"local[{CPUS}]").appName("estate-bench")
            .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
            .getOrCreate())


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    from estate_spark.operators import curate
    from estate_spark.plans import QUERIES, modelling, neighbours, reporting, sampling

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    stages = {"stage_curated": lambda: curate.curated(spark, SF_DIR), "stage_split": lambda: sampling.split(spark, SF_DIR),
              "stage_comps": lambda: neighbours.all_comps(spark, SF_DIR), "stage_models": lambda: modelling.bundle(spark, SF_DIR),
              "stage_cases": lambda: reporting.cases(spark, SF_DIR)}
    for name, build in stages.items():
        seconds[name] = round(timed(build), 3)
    for name in HEADLINE:
        def run(q=QUERIES[name]):
            q(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(min(timed(run), timed(run)), 3)
    rows = curate.curated(spark, SF_DIR).count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": int(CPUS), "listings": rows,
        "rows_per_sec": {"shap_rows": round(rows / seconds["shap_rows"]), "comparables": round(rows / seconds["comparables"])}}))
    spark.stop()


if __name__ == "__main__":
    main()
