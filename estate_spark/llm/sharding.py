"""Jump consistent hashing of stable keys to shards, with a gapless slot inside each shard.

Everything is DataFrame expressions. The shard of a key follows from the key and the shard
count alone: the 64-bit generator of the jump hash runs in two 32-bit halves, so that no
product leaves the long range. Slots number the rows of a shard in the order of the hashed
key; leading hash bits cut a shard into buckets, bucket totals give offsets, and rows are
ordered inside one bucket only. A bucket that one key fills (a third of all rows with the
same key, say) is cut further by input partition, so no task holds an unbounded group.

Defined results: a null key hashes as the empty string; a null text has no bytes (size 8,
checksum 0); equal keys always share a shard; rows equal in everything keep separate slots;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate_spark.session import written

# fixed values: the multiplier and the range of the published jump hash
MULTIPLIER = 2862933555777941757
RANGE = float(1 << 31)
# end of fixed values
ROW_OVERHEAD = 8                  # bytes counted for a row besides its text
BUCKET_ROWS = 100_000             # rows of one shard that a window orders at once
_MASK = (1 << 32) - 1
_M_HI, _M_LO = MULTIPLIER >> 32, MULTIPLIER & _MASK


def _low_product(x: Column, factor: int) -> Column:
    """x * factor mod 2^32, both below 2^32."""
    upper = (F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(0xFFFF)
    return (x.bitwiseAND(0xFFFF) * F.lit(factor) + F.shiftleft(upper, 16)).bitwiseAND(_MASK)


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 mod 2^64 for key = hi * 2^32 + lo."""
    p0 = lo.bitwiseAND(0xFFFF) * F.lit(_M_LO) + 1
    p1 = F.shiftright(lo, 16) * F.lit(_M_LO)
    low = p0.bitwiseAND(_MASK) + F.shiftleft(p1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low, 32)
    new_hi = (carry + _low_product(hi, _M_LO) + _low_product(lo, _M_HI)).bitwiseAND(_MASK)
    return new_hi, low.bitwiseAND(_MASK)


def key_halves(key: Column) -> tuple[Column, Column]:
    """The key's 64 hashed bits (leading half of its md5) as two longs below 2^32."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") for at in (1, 9))


def jump(hi: Column, lo: Column, shards: int) -> Column:
    """struct(shard, grown): the shard among ``shards`` and among ``shards + 1``. A jump only
    goes forward, so at most ``shards`` of them can lie below the count."""
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("bigint").alias("b"),
                     F.lit(0).cast("bigint").alias("j"))

    def step(s: Column, _: Column) -> Column:
        new_hi, new_lo = _next_state(s["hi"], s["lo"])
        ahead = ((s["j"] + 1).cast("double") * (F.lit(RANGE) / (F.shiftright(new_hi, 1) + 1).cast("double")))
        return F.when(s["j"] < shards, F.struct(
            new_hi.alias("hi"), new_lo.alias("lo"), s["j"].alias("b"),
            F.floor(ahead).cast("bigint").alias("j"))).otherwise(s)

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start, step,
        lambda s: F.struct(s["b"].cast("int").alias("shard"),
                           F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"]).cast("int").alias("grown")))


def assign(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, grown_shard, slot: one row per input row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), *[h.alias(n) for h, n in zip(key_halves(F.col(key)), ("_hi", "_lo"))])
    rows = rows.withColumn("_jump", jump(F.col("_hi"), F.col("_lo"), shards)).select(
        key, "size", "text_crc32", "_hi", "_lo", F.col("_jump.shard").alias("shard"),
        F.col("_jump.grown").alias("grown_shard"),
        F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    rows = written(rows, "shard_rows")       # fixes _part and _row; the texts are not kept
    bits = max(0, (rows.count() // (shards * BUCKET_ROWS)).bit_length())
    rows = rows.withColumn("_bucket", F.shiftright("_hi", 32 - bits))
    # a bucket far above the share that uniform keys give it is cut by input partition
    each = rows.groupBy("shard", "_bucket", "_part").agg(F.count("*").alias("_n"))
    whole = each.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    each = (each.join(whole, ["shard", "_bucket"])
            .withColumn("_cut", F.when(F.col("_all") > 4 * BUCKET_ROWS, F.col("_part")).otherwise(F.lit(-1))))
    groups = each.groupBy("shard", "_bucket", "_cut").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cut = each.filter("_cut >= 0").select("shard", "_bucket", "_part", "_cut")
    placed = (rows.join(cut, ["shard", "_bucket", "_part"], "left")
              .withColumn("_cut", F.coalesce("_cut", F.lit(-1))))
    inside = Window.partitionBy("shard", "_bucket", "_cut").orderBy("_hi", "_lo", "text_crc32", "size", "_row")
    placed = placed.withColumn("_pos", F.row_number().over(inside) - 1)
    out = placed.join(offsets.drop("_n"), ["shard", "_bucket", "_cut"])
    return out.select(key, "size", "text_crc32", "shard", "grown_shard",
                      (F.col("_off") + F.col("_pos")).cast("bigint").alias("slot"))
