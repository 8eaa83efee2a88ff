"""op11: the language of every document; a quarter of the rows is held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate_spark.llm import langid
from estate_spark.llm.registry import query, table


@query("op11_language_id")
def op11_language_id(spark, sf_dir):
    """Learned from the rows outside the held-out quarter, applied to all documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    out = langid.predict(docs, langid.train(docs.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
