"""Where jobs put intermediate tables, and the per-session table registry."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local runs without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="estate-spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path under the shared folder."""
    return f"{shared_dir(spark)}/estate_spark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 20_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` dealt over tasks of at most about ``rows_per_task`` rows: a compressed file of many rows
    is one task otherwise, however much each row then costs. ``df`` is a table, its count is cheap."""
    return df.repartition(-(-df.count() // rows_per_task) or 1)


def grown(df: DataFrame) -> DataFrame:
    """A join side that grows with the input: shuffled, never broadcast. The planner judges a
    pruned scan by its compressed bytes, which say little about its rows in memory."""
    return df.hint("merge")


def once(spark: SparkSession, key: tuple, build: Callable[[], object]):
    """Build a staged object once per Spark application (the pipeline's stage outputs:
    the curated table, the split, the trained models)."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STAGED:
        _STAGED[full] = build()
    return _STAGED[full]
