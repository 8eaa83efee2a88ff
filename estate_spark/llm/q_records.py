"""op3: all documents as token-id record files, read back."""

from __future__ import annotations

import public_tokenizers

from estate_spark.llm import records
from estate_spark.llm.registry import query, table
from estate_spark.session import scratch_path

VOCABULARY, END_ID = "word_bpe_49k.json", 1


@query("op3_token_records")
def op3_token_records(spark, sf_dir):
    """Ids by the public vocabulary, end id 1, ascending doc_id over the files."""
    folder = scratch_path(spark, "token-records")
    files = records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID, folder)
    return records.read_records(files, folder).withColumnRenamed("key", "doc_id")
