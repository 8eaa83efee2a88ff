"""All queries of this subpackage."""

from estate_spark.llm import (  # noqa: F401
    q_chat, q_decontaminate, q_gridcodes, q_langid, q_lines, q_lm, q_neardup, q_pieces, q_quality, q_records, q_sharding, q_spelling, q_toxicity,
)
from estate_spark.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
