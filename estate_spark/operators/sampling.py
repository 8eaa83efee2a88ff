"""Splits, samples and folds by seeded hash: stable under growth and re-runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.operators import ranks
from estate_spark.session import written

# fixed values
SEED = 42
TEST_SHARE, VAL_SHARE_OF_REST = 0.20, 0.20
N_FOLDS, STOP_SHARE = 5, 0.1


def split_3way(df: DataFrame, key: str = "asset_id", seed: int = SEED, exact: bool = True) -> DataFrame:
    """key, split with exactly ceil(0.2 n) test rows and ceil(0.2 of the rest) val rows, in
    hash order: every row is compared with the rows at the two cut-offs. ``exact=False``
    compares the hash with fixed cut-offs instead (shares right on average)."""
    ids = df.select(key)
    if not exact:
        share = ranks.seeded_hash(key, seed) / F.lit(float(2 ** ranks.HASH_BITS))
        val_end = TEST_SHARE + (1 - TEST_SHARE) * VAL_SHARE_OF_REST
        return ids.select(key, F.when(share < TEST_SHARE, "test").when(share < val_end, "val")
                          .otherwise("train").alias("split"))
    def wanted(n: Column) -> list[Column]:
        test = ranks.ceil_share(n, TEST_SHARE)
        return [test, test + ranks.ceil_share(n - test, VAL_SHARE_OF_REST)]

    cuts = written(ranks.hash_cutoffs(ids, key, seed, [], wanted), "split-cutoffs")
    test, val = (ranks.before_cutoff(key, seed, cuts.select(c).scalar()) for c in ("cut0", "cut1"))
    return ids.filter(F.col(key).isNotNull()).select(key, F.when(test, "test").when(val, "val").otherwise("train").alias("split"))


def hash_sample(df: DataFrame, key: str, share: float, seed: int = SEED) -> DataFrame:
    """Rows whose key hash is below the share; the key's rows stay together."""
    return df.filter(ranks.seeded_hash(key, seed) < F.lit(int(share * 2 ** ranks.HASH_BITS)))


def fold_of(key: str, k: int = N_FOLDS, seed: int = SEED) -> Column:
    return F.pmod(ranks.seeded_hash(key, seed), F.lit(k)).cast("int")


def held_out(group: str, share: float = STOP_SHARE, seed: int = SEED) -> Column:
    """True for the groups set aside; a group's rows move together."""
    return ranks.seeded_hash(group, seed) < F.lit(int(share * 2 ** ranks.HASH_BITS))


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int = SEED) -> DataFrame:
    """Per class the first ceil(class share x n) rows in hash order, then at most n rows in
    all, again in hash order. Rows are compared with their class's cut-off where they lie;
    only what is below it, about n rows, is written and cut once more."""
    total = df.filter(F.col(key).isNotNull()).count()
    quota = F.ceil(F.try_divide(F.col("class_rows"), F.lit(total)) * F.lit(float(n)))
    cuts = written(ranks.hash_cutoffs(df, key, seed, [label], lambda rows: [quota]), "sample-cutoffs").select(F.col(label).alias("_class"), F.col("cut0").alias("_cut"))
    below = df.filter(F.col(key).isNotNull()).join(ranks.few(cuts), F.col(label).eqNullSafe(F.col("_class"))).filter(
        ranks.before_cutoff(key, seed, F.col("_cut"))).select(*df.columns)
    picked = written(below, "sample")
    cut = written(ranks.hash_cutoffs(picked, key, seed, [], lambda rows: [F.lit(n)]), "sample-cutoff")
    return picked.filter(ranks.before_cutoff(key, seed, cut.select("cut0").scalar()))
