"""Fill entered subjects with their zone's medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark import contract as C
from estate_spark.operators import explore


def fill_zone_defaults(inputs: DataFrame, listings: DataFrame, cols: list[str]) -> DataFrame:
    """Entered values win, the rest is the zone median; age and the type flags follow from
    the entered year and type. The zone table has one row per zone, so the join is against
    a table that does not grow with the listings."""
    zone = explore.group_median_all(listings, ["neighborhood_id", "neighborhood_name"], cols)
    given = [c for c in cols if c in inputs.columns]
    zone = zone.withColumnsRenamed({c: f"_zone_{c}" for c in given})
    out = inputs.drop("neighborhood_name").join(zone, "neighborhood_id", "left")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_zone_{c}")) for c in given})
    return (out.drop(*[f"_zone_{c}" for c in given])
            .withColumn("property_age", F.lit(float(C.REFERENCE_YEAR)) - F.col("construction_year"))
            .withColumn("is_duplex", F.when(F.col("property_type") == "duplex", 1.0).otherwise(0.0))
            .withColumn("is_studio", F.when(F.col("property_type") == "studio", 1.0).otherwise(0.0)))
