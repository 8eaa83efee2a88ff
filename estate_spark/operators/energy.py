"""Old-versus-new stock gap per zone with a citywide fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.functions import rules
from estate_spark.operators import ranks
from estate_spark.session import grown

MIN_SEGMENT_N = 20              # fixed value


def segment_stats(listings: DataFrame, by: list[str], small: bool | None = None) -> DataFrame:
    """by..., n_old, n_new, median_old, median_new of EUR/m2 by build-year segment."""
    rows = rules.with_coalesced_year(listings).select(
        *by, F.when(F.col("year") <= rules.OLD_YEAR_MAX, F.col("unit_price_m2")).alias("old"),
        F.when(F.col("year") >= rules.NEW_YEAR_MIN, F.col("unit_price_m2")).alias("new"))
    small = ranks.is_small(listings) if small is None else small
    counts = [F.count("old").alias("n_old"), F.count("new").alias("n_new")]
    if small:
        return rows.groupBy(*by).agg(*counts, F.percentile("old", 0.5).alias("median_old"),
                                     F.percentile("new", 0.5).alias("median_new"))
    med = ranks.medians(rows, ["old", "new"], by, small=False).withColumnsRenamed(
        {"old": "median_old", "new": "median_new"})
    n = rows.groupBy(*by).agg(*counts)
    return n.join(med, by, "left") if by else n.withColumn(
        "_m", med.agg(F.struct(F.max("median_old").alias("o"), F.max("median_new").alias("n"))).scalar()
    ).select("n_old", "n_new", F.col("_m.o").alias("median_old"), F.col("_m.n").alias("median_new"))


def segment_gap(subjects: DataFrame, listings: DataFrame, min_n: int = MIN_SEGMENT_N,
                small: bool | None = None) -> DataFrame:
    """subject_id and the ``impact`` struct: local scope when the subject's zone has enough
    rows on both sides, else citywide, else null. One aggregate row per zone meets the
    subjects, so the fallback needs no correlated query."""
    small = ranks.is_small(listings) if small is None else small
    local = segment_stats(listings.filter("neighborhood_id is not null"), ["neighborhood_id"], small)
    city = segment_stats(listings, [], small).agg(F.struct(*[
        F.max(c).alias(c) for c in ("n_old", "n_new", "median_old", "median_new")])).scalar()
    stats = ["n_old", "n_new", "median_old", "median_new"]
    joined = subjects.select("subject_id", "neighborhood_id", "neighborhood_name", "area_m2").join(
        local.select("neighborhood_id", F.struct(*stats).alias("_local")), "neighborhood_id", "left")
    joined = joined.withColumn("_city", city)

    def enough(c):
        return (F.col(f"{c}.n_old") >= min_n) & (F.col(f"{c}.n_new") >= min_n)

    picked = F.when(enough("_local"), F.col("_local")).when(enough("_city"), F.col("_city"))
    scope = F.when(enough("_local"), F.concat(F.lit("barrio "), F.col("neighborhood_name"))).otherwise(
        "Madrid citywide")
    out = joined.withColumn("_pick", picked).withColumn("_scope", scope)
    old = F.rint(F.col("_pick.median_old")).cast("bigint")
    new = F.rint(F.col("_pick.median_new")).cast("bigint")
    area = F.rint("area_m2").cast("bigint")
    return out.select("subject_id", F.when(F.col("_pick").isNotNull(), F.struct(
        F.col("_scope").alias("scope"), F.col("_pick.n_old").alias("n_old"), F.col("_pick.n_new").alias("n_new"),
        old.alias("median_old_eur_m2"), new.alias("median_new_eur_m2"), (new - old).alias("gap_eur_m2"),
        area.alias("subject_area_m2"), ((new - old) * area).alias("subject_gap_eur"))).alias("impact"))


def energy(subjects: DataFrame, listings: DataFrame) -> DataFrame:
    """subject_id, band, band_is_proxy, flag, effective_year, year_source, impact."""
    band = rules.with_energy_band(subjects).select(
        "subject_id", "band", F.lit(True).alias("band_is_proxy"), "flag", "effective_year", "year_source")
    return band.join(grown(segment_gap(subjects, listings)), "subject_id")
