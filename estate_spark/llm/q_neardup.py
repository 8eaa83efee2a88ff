"""op7: all documents joined on near-equal texts."""

from __future__ import annotations

from estate_spark.llm import neardup
from estate_spark.llm.registry import query, table


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark, sf_dir):
    """Runs of five words, similarity 0.8: class, copies and links of every document."""
    return neardup.join(table(spark, sf_dir, "documents")).drop("row")
