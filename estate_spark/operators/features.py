"""Feature preparation fitted on the train rows, applied as column expressions and, for
categories, as a join with a dictionary of levels that may be of any size."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark import contract as C
from estate_spark.operators import ranks
from estate_spark.session import written

YEAR_MISSING = "year_missing"
YEAR_SOURCE = "construction_year"
#: Spark's trees hold a histogram bin a level in every task; wider columns go to one_hot.
TREE_LEVELS = 10_000


@dataclass
class Prep:
    """What a transform needs: a few numbers per column and the category levels."""
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)


def fit_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, level, idx: the distinct non-null values of each column, numbered densely
    in order. Levels are sorted by range partitions; a partition's share of a column starts at
    the count of those before it, so no task and no driver holds a column's levels."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in cols])).alias("r"))
    distinct = cells.select("r.*").filter("level is not null").distinct()
    placed = written(distinct.repartitionByRange("column_name", "level").withColumn("_part", F.spark_partition_id()), "levels")
    before = Window.partitionBy("column_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("column_name", "_part").agg(F.count("*").alias("_n")).select(
        "column_name", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("column_name", "_part").orderBy("level"))
    numbered = placed.withColumn("_at", inner).join(starts, ["column_name", "_part"])
    return written(numbered.select("column_name", "level", (F.col("_start") + F.col("_at") - 1).alias("idx")), "level-dictionary")


def level_counts(levels: DataFrame, cols: list[str]) -> dict[str, int]:
    """Levels of each column."""
    found = {r["column_name"]: r["count"] for r in levels.groupBy("column_name").count().collect()}
    return {c: found.get(c, 0) for c in cols}


def encode(df: DataFrame, levels: DataFrame, cols: list[str]) -> DataFrame:
    """<col>_index: number of the row's level, null when unseen or null. A dictionary is
    broadcast up to a counted size; beyond, the join shuffles and adaptive execution splits the
    rows of a frequent level."""
    out = df
    for c in cols:
        mine = levels.filter(F.col("column_name") == c).select(F.col("level").alias("_level"), F.col("idx").alias(f"{c}_index"))
        out = out.join(ranks.few(mine), F.col(c).cast("string") == F.col("_level"), "left").drop("_level")
    return out


def one_hot(df: DataFrame, levels: DataFrame, cols: list[str]) -> DataFrame:
    """<col>_onehot: a sparse vector a column with a slot a level and a last one for unseen or
    null values; its size doesn't depend on the number of levels."""
    sizes = level_counts(levels, cols)
    indexed = encode(df, levels, cols).withColumns({f"{c}_index": F.coalesce(f"{c}_index", F.lit(sizes[c])).cast("double") for c in cols})
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_onehot" for c in cols], dropLast=False)
    widest = df.sparkSession.createDataFrame([tuple(float(sizes[c]) for c in cols)], [f"{c}_index" for c in cols])
    return encoder.fit(widest).transform(indexed).drop(*[f"{c}_index" for c in cols])


def impute(df: DataFrame, prep: Prep) -> DataFrame:
    """Nulls (and NaN) to the train median, with an indicator for the build year."""
    out = df.withColumn(YEAR_MISSING, ranks.no_nan(F.col(YEAR_SOURCE).cast("double")).isNull().cast("double"))
    return out.withColumns({c: F.coalesce(ranks.no_nan(F.col(c).cast("double")), F.lit(prep.medians[c]))
                            for c in prep.numeric})


def standardize(df: DataFrame, prep: Prep) -> DataFrame:
    """(x - mean) / population std of the imputed columns; a zero std counts as 1."""
    return df.withColumns({c: (F.col(c) - F.lit(prep.means[c])) / F.lit(prep.stds[c]) for c in prep.numeric})


def fit(train: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
        small: bool | None = None) -> Prep:
    """Three one-row aggregates over the train rows: medians, then moments of the imputed
    columns, and the level lists of the tree models' categories."""
    roles = C.feature_roles()
    prep = Prep(list(numeric or roles.numeric), list(roles.categorical if categorical is None else categorical))
    med = ranks.medians(train, prep.numeric, small=small).first()
    prep.medians = {c: float(med[c]) if med[c] is not None else 0.0 for c in prep.numeric}
    filled = impute(train, prep)
    mom = filled.agg(*[a for c in prep.numeric for a in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    prep.means = {c: mom[f"m_{c}"] for c in prep.numeric}
    prep.stds = {c: mom[f"s_{c}"] or 1.0 for c in prep.numeric}
    if prep.categorical:
        levels = fit_levels(train, prep.categorical)
        wide = [c for c, n in level_counts(levels, prep.categorical).items() if n > TREE_LEVELS]
        if wide:
            raise ValueError(f"too many levels for the trees' category columns: {wide}")
        rows = levels.orderBy("column_name", "idx").collect()     # at most TREE_LEVELS a column
        prep.levels = {c: [r["level"] for r in rows if r["column_name"] == c] for c in prep.categorical}
    return prep


def width(prep: Prep) -> int:
    """Columns of the standardized and one-hot encoded matrix."""
    return len(prep.numeric) + 1 + sum(len(v) + 1 for v in prep.levels.values())


def log_target_stats(train: DataFrame, target: str = C.TARGET) -> tuple[float, float]:
    row = train.agg(F.avg(F.ln(target)).alias("m"), F.stddev_pop(F.ln(target)).alias("s")).first()
    return row["m"], row["s"] or 1.0


def to_log_target(col: str, mean: float, std: float) -> Column:
    return (F.ln(col) - F.lit(mean)) / F.lit(std)


def from_log_target(col: str, mean: float, std: float) -> Column:
    return F.exp(F.col(col) * F.lit(std) + F.lit(mean))
