"""Market exploration: filters, group medians, deltas, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.operators import ranks

ALL = "All"


def explore_filter(df: DataFrame, zones: list[str], low: float, high: float) -> DataFrame:
    """Zone selection and inclusive price range; "All" or nothing selected means every
    zone, which still leaves out rows without one."""
    every = not zones or ALL in zones
    picked = F.col("neighborhood_name").isNotNull() if every else F.col("neighborhood_name").isin(zones)
    return df.filter(picked & F.col("price").between(low, high))


def group_medians(df: DataFrame, by: str = "neighborhood_name", small: bool | None = None) -> DataFrame:
    """by, median_price, median_eur_m2, n over rows that have a group."""
    rows = df.filter(F.col(by).isNotNull()).select(by, "price", "unit_price_m2")
    small = ranks.is_small(rows) if small is None else small
    if small:
        return rows.groupBy(by).agg(F.percentile("price", 0.5).alias("median_price"),
                                    F.percentile("unit_price_m2", 0.5).alias("median_eur_m2"),
                                    F.count("*").alias("n"))
    med = ranks.medians(rows, ["price", "unit_price_m2"], [by], small=False)
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return med.join(n, by).select(by, F.col("price").alias("median_price"),
                                  F.col("unit_price_m2").alias("median_eur_m2"), "n")


def top_groups(summary: DataFrame, metric: str, n: int, by: str = "neighborhood_name") -> DataFrame:
    return summary.orderBy(F.col(metric).desc(), by).limit(n)


def group_median_all(df: DataFrame, by: list[str], cols: list[str], small: bool | None = None) -> DataFrame:
    """Median of every numeric column per group; rows without a group are left out."""
    return ranks.medians(df.filter(F.col(by[0]).isNotNull()), cols, by, small)


def kpi_delta(df: DataFrame, picked: Column, small: bool | None = None) -> DataFrame:
    """One row: count, median price, mean area and mean EUR/m2 of the selection and the
    difference to all rows."""
    rows = df.select("price", "area_m2", "unit_price_m2", F.coalesce(picked, F.lit(False)).alias("picked"))
    small = ranks.is_small(rows) if small is None else small

    def only(c: str) -> Column:
        return F.when(F.col("picked"), F.col(c))

    aggs = [F.count_if("picked").alias("n"), F.count("*").alias("n_all")]
    for c, name in (("area_m2", "mean_area"), ("unit_price_m2", "mean_eur_m2")):
        aggs += [F.avg(only(c)).alias(name), F.avg(c).alias(f"{name}_all")]
    if small:
        aggs += [F.percentile(only("price"), 0.5).alias("median_price"),
                 F.percentile("price", 0.5).alias("median_price_all")]
        one = rows.agg(*aggs)
    else:
        both = rows.select(only("price").alias("median_price"), F.col("price").alias("median_price_all"))
        med = ranks.medians(both, ["median_price", "median_price_all"], small=False).agg(F.struct(
            F.max("median_price").alias("a"), F.max("median_price_all").alias("b"))).scalar()
        one = (rows.agg(*aggs).withColumn("median_price", med["a"])
               .withColumn("median_price_all", med["b"]))
    return one.select("n", (F.col("n") - F.col("n_all")).alias("n_delta"), *[
        x for m in ("median_price", "mean_area", "mean_eur_m2")
        for x in (F.col(m), (F.col(m) - F.col(f"{m}_all")).alias(f"{m}_delta"))])


def histogram(df: DataFrame, col: str, bins: int = 40, small: bool | None = None) -> DataFrame:
    """bin, bin_low, bin_high, n, median_marker: equal widths between min and max, the last
    bin closed, empty bins kept."""
    small = ranks.is_small(df) if small is None else small
    v = F.col(col).cast("double")
    rng = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    lo, width = rng["lo"], (rng["hi"] - rng["lo"]) / F.lit(float(bins))
    bin_no = F.when(width > 0, F.least(F.floor((v - lo) / F.nullif(width, F.lit(0.0))),
                                       F.lit(bins - 1))).otherwise(F.lit(0))
    counts = (df.filter(v.isNotNull()).select(bin_no.cast("int").alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("n")))
    med = ranks.medians(df.select(v.alias("m")), ["m"], small=small).scalar()
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("bin_low"),
        (lo + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"), med.alias("median_marker"))


def scatter(df: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """Plot columns of all rows; ``share`` takes a hash sample of the ids."""
    if share is not None:
        df = df.filter(ranks.seeded_hash("asset_id", seed) < F.lit(int(share * 2 ** ranks.HASH_BITS)))
    return df.select("asset_id", "area_m2", "price", "property_type")


def distinct_list(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)


def first_by(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """The row with the smallest key."""
    return df.agg(F.min_by(F.struct(key, *cols), key).alias("r")).select("r.*")


def extremes(df: DataFrame, col: str, key: str, keep: list[str]) -> DataFrame:
    """Cheapest and dearest row, ties by the smaller key."""
    row = F.struct(key, *keep)
    one = df.agg(F.min_by(row, F.struct(col, key)).alias("lowest"),
                 F.min_by(row, F.struct(-F.col(col), F.col(key))).alias("highest"))
    return one.select(F.explode(F.array(
        F.struct(F.lit("lowest").alias("which"), F.col("lowest").alias("r")),
        F.struct(F.lit("highest").alias("which"), F.col("highest").alias("r")))).alias("x")
    ).select("x.which", "x.r.*")


def pick_at_quantiles(df: DataFrame, picks: list[tuple[str, float]], keep: list[str],
                      small: bool | None = None) -> DataFrame:
    """Per (label, q): the row whose price is nearest to that price quantile, ties by id."""
    rows = df.filter(F.col("neighborhood_id").isNotNull())
    q = ranks.quantile_rows(rows, ["price"], [q for _, q in picks], method="nearest", small=small)
    target = q.agg(F.struct(*[F.max(ranks._label(v)).alias(label) for label, v in picks])).scalar()
    row = F.struct("asset_id", *keep)
    one = rows.agg(*[F.min_by(row, F.struct(F.abs(F.col("price") - target[label]), F.col("asset_id")))
                     .alias(label) for label, _ in picks])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.col(label).alias("r")) for label, _ in picks
    ])).alias("x")).select("x.label", "x.r.*")
