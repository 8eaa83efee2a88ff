"""op5: every document encoded to the public model's ids and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from estate_spark.llm import pieces
from estate_spark.llm.registry import query, table

MODEL = "piece_bpe_32k.model"


@query("op5_sentencepiece")
def op5_sentencepiece(spark, sf_dir):
    """ids of whole texts; n_ids, and length and md5 of the text decoded from them."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(MODEL)
    out = pieces.decode(pieces.encode(docs, path), path)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids",
                      F.char_length("decoded").cast("bigint").alias("n_chars"), F.md5("decoded").alias("text_md5"))
