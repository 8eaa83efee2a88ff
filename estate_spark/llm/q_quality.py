"""op10: every document's counts and verdict."""

from __future__ import annotations

from estate_spark.llm import quality
from estate_spark.llm.registry import query, table


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    """Base rule and divergence from the references of all documents."""
    return quality.judge(table(spark, sf_dir, "documents"))
