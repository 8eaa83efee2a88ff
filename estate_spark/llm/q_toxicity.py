"""op2: every document scored; a fifth of the labels is held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.llm import toxicity
from estate_spark.llm.registry import query, table


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    """Fitted on labels outside the held-out fifth, applied to all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    sample = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.score(docs, toxicity.fit(sample))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
