"""A filter of fixed size over a column of longs, in DataFrame operations.

The low ``LOG2`` bits of the keys become bitmap pages of 4 KB, at most 2 ** (LOG2 - 15) of them
(16 MB), so the pages can be broadcast whatever the number of keys. Rows that pass may still be
strangers (more of them as keys get many); a join on the full key must follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2 = 27


def page(key: str) -> Column:
    return F.expr(f"bitmap_bucket_number(pmod({key}, {1 << LOG2}L))")


def place(key: str) -> Column:
    return F.expr(f"bitmap_bit_position(pmod({key}, {1 << LOG2}L))")


def marked(key: str, only: str = "true") -> Column:
    """Aggregate: the page's bitmap of the keys for which ``only`` holds."""
    return F.expr(f"bitmap_construct_agg(CASE WHEN {only} THEN bitmap_bit_position(pmod({key}, {1 << LOG2}L)) END)")


def has(bits: str, key: str) -> Column:
    """Whether the key's bit is set in its page."""
    at = place(key)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(at, F.lit(8)))).cast("int"), F.lit(2)) == 1


def passing(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be one of ``keys`` (a column of the same name)."""
    pages = keys.groupBy(page(key).alias("_page")).agg(marked(key).alias("_bits"))
    return df.withColumn("_page", page(key)).join(F.broadcast(pages), "_page").filter(has("_bits", key)).drop("_page", "_bits")
