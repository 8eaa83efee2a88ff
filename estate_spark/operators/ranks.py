"""Exact order statistics and running sums without a one-task group.

``percentile`` and an unpartitioned window keep a whole group in one task. That is fine
for a group known to be small; beyond ``SMALL_ROWS`` the functions here cut the value
axis into equi-depth buckets: the edges are approximate percentiles (one bounded row,
fixed before use), rows are first combined to distinct values, bucket totals give each
bucket its offset, and only then are values ordered inside one bucket. Since the edges
are equi-depth over all rows, no (group, bucket) holds more than about 1/1024 of the
rows however large a single group is; a quantile orders only the buckets its ranks fall
in. Results are exact on both paths.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from estate_spark.session import written

SMALL_ROWS = 2_000_000
_FAN = 32                       # 32 x 32 = 1024 buckets, found by two short scans
SERIES, VALUE, WEIGHT = "series", "value", "weight"


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """True when ``df`` has at most ``limit`` rows. A count combines map-side and, on a
    written table, reads no column; ``limit(n).count()`` would send n rows per task to one."""
    limit = SMALL_ROWS if limit is None else limit
    return limit > 0 and df.count() <= limit


def no_nan(col: Column | str) -> Column:
    """NaN -> null, so it neither sorts above every number nor joins a median."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def long_format(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """keep..., series, value: one row per non-null (and not NaN) cell of ``cols``."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias(SERIES), F.col(c).alias(VALUE)) for c in cols])
    return (wide.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")
            .filter(F.col(VALUE).isNotNull() & ~F.isnan(VALUE)))


def value_edges(df: DataFrame) -> dict[str, list[float]]:
    """Per series, its 1023 equi-depth edges: bounded by the number of columns."""
    qs = [i / (_FAN * _FAN) for i in range(1, _FAN * _FAN)]
    rows = (df.groupBy(SERIES)
            .agg(F.percentile_approx(VALUE, qs, 20 * _FAN * _FAN).alias("edges")).collect())
    return {r[SERIES]: r["edges"] for r in rows}


def bucket_of(value: Column, edges: Column) -> Column:
    """Number of edges <= value, by a coarse scan and a fine scan of 31 edges each."""
    coarse = F.transform(F.sequence(F.lit(1), F.lit(_FAN - 1)),
                         lambda i: F.element_at(edges, i * _FAN))
    c = F.size(F.filter(coarse, lambda e: e <= value))
    fine = F.slice(edges, c * _FAN + 1, F.lit(_FAN - 1))
    return c * _FAN + F.size(F.filter(fine, lambda e: e <= value))


def _with_bucket(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    spark = df.sparkSession
    schema = T.StructType([T.StructField(SERIES, T.StringType()),
                           T.StructField("edges", T.ArrayType(T.DoubleType()))])
    table = spark.createDataFrame(list(edges.items()), schema)
    return (df.join(F.broadcast(table), SERIES)
            .withColumn("bucket", bucket_of(F.col(VALUE), F.col("edges"))).drop("edges"))


def running_counts(df: DataFrame, by: list[str], weights: list[str], small: bool,
                   wanted: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """Per (series, by) in value order: one row per distinct value with, for each weight
    w, its sum ``w``, the sum over smaller values ``w_before`` and the group total
    ``w_total``. ``df`` holds series, by..., value and the weights.

    ``wanted`` maps the total of the first weight to 0-based ranks; then only values in
    the buckets holding those ranks need to come back.
    """
    keys = [SERIES, *by]
    if small:
        vc = df.groupBy(*keys, VALUE).agg(*[F.sum(w).alias(w) for w in weights])
        w_run = (Window.partitionBy(*keys).orderBy(VALUE)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        w_all = Window.partitionBy(*keys)
        return vc.select("*",
                         *[(F.sum(w).over(w_run) - F.col(w)).alias(f"{w}_before") for w in weights],
                         *[F.sum(w).over(w_all).alias(f"{w}_total") for w in weights])
    edges = value_edges(df)
    vc = df.groupBy(*keys, VALUE).agg(*[F.sum(w).alias(w) for w in weights])
    vc = _with_bucket(vc, edges)
    totals = vc.groupBy(*keys, "bucket").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    w_off = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(
        *keys, "bucket",
        *[(F.sum(f"_{w}").over(w_off) - F.col(f"_{w}")).alias(f"{w}_offset") for w in weights],
        *[F.sum(f"_{w}").over(Window.partitionBy(*keys)).alias(f"{w}_total") for w in weights],
        *[F.col(f"_{w}").alias(f"{w}_here") for w in weights])
    if wanted is not None:
        w0 = weights[0]
        start, end = F.col(f"{w0}_offset"), F.col(f"{w0}_offset") + F.col(f"{w0}_here")
        offsets = offsets.filter(reduce(Column.__or__, [
            (start <= r) & (r < end) for r in wanted(F.col(f"{w0}_total"))]))
    offsets = offsets.drop(*[f"{w}_here" for w in weights])
    right = [*keys, "bucket"]
    offsets = offsets.withColumnsRenamed({c: f"_right_{c}" for c in right})
    # null-safe on the group keys: a null group is a group
    on = reduce(Column.__and__, [
        F.col(c).eqNullSafe(F.col(f"_right_{c}")) if c in by else F.col(c) == F.col(f"_right_{c}") for c in right])
    joined = vc.join(offsets, on).drop(*[f"_right_{c}" for c in right])
    w_in = (Window.partitionBy(*keys, "bucket").orderBy(VALUE)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select(
        *keys, VALUE, *weights,
        *[(F.col(f"{w}_offset") + F.sum(w).over(w_in) - F.col(w)).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_total") for w in weights])


def _label(q: float) -> str:
    return f"q{q:g}".replace(".", "_")


def quantile_rows(df: DataFrame, cols: list[str], qs: list[float], by: list[str] = (),
                  method: str = "linear", small: bool | None = None) -> DataFrame:
    """by..., series, n, and one column per quantile (``q0_5`` ...).

    ``linear`` interpolates between the neighbours of rank (n-1)q; ``nearest`` takes the
    element at round-half-up((n-1)q).
    """
    by = list(by)
    small = is_small(df) if small is None else small
    long = long_format(df, cols, by)
    if small and method == "linear":
        arr = F.percentile(VALUE, list(qs))
        out = long.groupBy(*by, SERIES).agg(F.count(VALUE).alias("n"), arr.alias("_q"))
        return out.select(*by, SERIES, "n",
                          *[F.col("_q")[i].alias(_label(q)) for i, q in enumerate(qs)])

    def wanted(total: Column) -> list[Column]:
        pos = [(total - 1) * F.lit(float(q)) for q in qs]
        return ([F.floor(p + 0.5) for p in pos] if method == "nearest"
                else [f(p) for p in pos for f in (F.floor, F.ceil)])

    ranked = running_counts(long.withColumn(WEIGHT, F.lit(1)), by, [WEIGHT], small, wanted)
    n, before = F.col(f"{WEIGHT}_total"), F.col(f"{WEIGHT}_before")
    after = before + F.col(WEIGHT)

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < after), F.col(VALUE)))

    aggs = [F.max(n).alias("n")]
    for i, q in enumerate(qs):
        pos = (n - 1) * F.lit(float(q))
        if method == "nearest":
            aggs.append(at(F.floor(pos + 0.5)).alias(f"lo{i}"))
        else:
            aggs += [at(F.floor(pos)).alias(f"lo{i}"), at(F.ceil(pos)).alias(f"hi{i}")]
    out = ranked.groupBy(*by, SERIES).agg(*aggs)
    sel = []
    for i, q in enumerate(qs):
        if method == "nearest":
            sel.append(F.col(f"lo{i}").alias(_label(q)))
        else:
            pos = (F.col("n") - 1) * F.lit(float(q))
            frac = pos - F.floor(pos)
            # equal neighbours are the quantile, bit for bit, as in ``percentile``
            sel.append(F.when((frac == 0) | (F.col(f"lo{i}") == F.col(f"hi{i}")), F.col(f"lo{i}")).otherwise(
                F.col(f"lo{i}") * (1 - frac) + F.col(f"hi{i}") * frac).alias(_label(q)))
    return out.select(*by, SERIES, "n", *sel)


def medians(df: DataFrame, cols: list[str], by: list[str] = (),
            small: bool | None = None) -> DataFrame:
    """by..., then the exact median of every column under its own name."""
    by = list(by)
    small = is_small(df) if small is None else small
    if small:
        return df.groupBy(*by).agg(
            *[F.percentile(no_nan(F.col(c).cast("double")), 0.5).alias(c) for c in cols])
    rows = quantile_rows(df, cols, [0.5], by, small=False)
    found = rows.groupBy(*by).agg(
        *[F.max(F.when(F.col(SERIES) == c, F.col("q0_5"))).alias(c) for c in cols])
    if not by:
        return found
    # a group whose values are all null is a group, as is the null group
    groups = df.select(*by).distinct()
    found = found.withColumnsRenamed({c: f"_right_{c}" for c in by})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by])
    return groups.join(found, on, "left").select(*by, *cols)


def kth_smallest(df: DataFrame, col: str, k: Column, small: bool | None = None) -> DataFrame:
    """One row: n and the k-th smallest value of ``col`` (1-based; ``k`` may use ``n``)."""
    small = is_small(df) if small is None else small
    long = long_format(df, [col], []).withColumn(WEIGHT, F.lit(1))
    if not small:
        # the k-th value is the element of rank k-1 of a one-row count
        row = long.agg(F.count("*").alias("n")).withColumn("k", k).first()
        ranked = running_counts(long, [], [WEIGHT], False, lambda total: [F.lit(row["k"] - 1)])
    else:
        ranked = running_counts(long, [], [WEIGHT], True)
    ranked = ranked.withColumn("n", F.col(f"{WEIGHT}_total")).withColumn("k", k)
    before = F.col(f"{WEIGHT}_before")
    hit = (before < F.col("k")) & (F.col("k") <= before + F.col(WEIGHT))
    return ranked.agg(F.max("n").alias("n"), F.max("k").alias("k"),
                      F.max(F.when(hit, F.col(VALUE))).alias("kth"))


HASH_BITS = 32


def seeded_hash(key: Column | str, seed: int) -> Column:
    """32 uniform bits per key: the first 8 hex digits of md5("<key>:<seed>")."""
    text = F.concat(F.col(key) if isinstance(key, str) else key, F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, key: str, seed: int, by: list[str] = (),
              buckets_log2: int = 14) -> DataFrame:
    """Add ``hash_rank`` (0-based, by (hash, key)) and ``class_rows`` per ``by`` group.

    The hash is uniform, so its leading bits cut any group into equal buckets; a group's
    bucket totals give the offsets and rows are ordered within one bucket only.
    """
    by = list(by)
    h = df.withColumn("_h", seeded_hash(key, seed))
    h = h.withColumn("_b", F.shiftright("_h", HASH_BITS - buckets_log2))
    totals = h.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(
        *by, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("class_rows"))
    inner = h.withColumn("_r", F.row_number().over(
        Window.partitionBy(*by, "_b").orderBy("_h", key)))
    offsets = offsets.withColumnsRenamed({c: f"_right_{c}" for c in [*by, "_b"]})
    # null-safe on the class: rows without one form a class too
    on = reduce(Column.__and__, [F.col("_b") == F.col("_right__b"),
                                 *[F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by]])
    return (inner.join(offsets, on).withColumn("hash_rank", F.col("_off") + F.col("_r") - 1)
            .drop("_h", "_b", "_r", "_off", "_right__b", *[f"_right_{c}" for c in by]))


def hash_cutoffs(df: DataFrame, key: str, seed: int, by: list[str], wanted: Callable[[Column], list[Column]],
                 buckets_log2: int = 14) -> DataFrame:
    """by..., class_rows, cut0, cut1, ...: per class the (hash, key) of the rows at the wanted
    0-based ranks in hash order, null for a rank beyond the class.

    Rows are counted per hash bucket, which combines map-side; only those in the buckets of the
    cut-offs, 1 in 2^14 each, are shuffled and ordered. To keep the first r rows of a class,
    compare every row with its class's cut-off (``before_cutoff``): no row has to move.
    Rows without a key have no rank.
    """
    by = list(by)
    h = df.filter(F.col(key).isNotNull()).select(*by, F.col(key).alias("_k"), seeded_hash(key, seed).alias("_h"))
    h = h.withColumn("_b", F.shiftright("_h", HASH_BITS - buckets_log2))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = h.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(
        *by, "_b", "_n", (F.sum("_n").over(w) - F.col("_n")).alias("_off"), F.sum("_n").over(Window.partitionBy(*by)).alias("class_rows"))
    totals = written(totals, "hash-buckets")                 # classes x 2^14 rows at most
    wants = wanted(F.col("class_rows"))
    places = F.array(*[F.struct(F.lit(i).alias("_i"), r.cast("bigint").alias("_r")) for i, r in enumerate(wants)])
    located = totals.select(*by, "_b", "_n", "_off", F.explode(places).alias("_p")).select(
        *by, "_b", "_p._i", (F.col("_p._r") - F.col("_off")).alias("_rest"), "_n").filter("_rest >= 0 and _rest < _n").drop("_n")
    located = written(located, "hash-cutoffs").withColumnsRenamed({c: f"_right_{c}" for c in [*by, "_b"]})
    on = reduce(Column.__and__, [F.col("_b") == F.col("_right__b"), *[F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by]])
    near = h.join(few(located), on).withColumn("_at", F.row_number().over(
        Window.partitionBy(*by, "_i").orderBy("_h", "_k")))
    cuts = near.filter(F.col("_at") == F.col("_rest") + 1).groupBy(*by).agg(*[
        F.max(F.when(F.col("_i") == i, F.struct("_h", "_k"))).alias(f"cut{i}") for i in range(len(wants))])
    classes = totals.groupBy(*by).agg(F.max("class_rows").alias("class_rows"))
    if not by:
        return classes.join(cuts, F.lit(True), "left")
    cuts = cuts.withColumnsRenamed({c: f"_right_{c}" for c in by})
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by])
    return classes.join(cuts, on, "left").drop(*[f"_right_{c}" for c in by])


FEW_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """A table with a broadcast hint where a count says it has at most FEW_ROWS rows."""
    return F.broadcast(df) if is_small(df, FEW_ROWS) else df


def before_cutoff(key: str, seed: int, cut: Column) -> Column:
    """Whether a row comes before the (hash, key) ``cut`` in hash order; always, without one."""
    h = seeded_hash(key, seed)
    return cut.isNull() | (h < cut["_h"]) | ((h == cut["_h"]) & (F.col(key) < cut["_k"]))


def ceil_share(n: Column, share: float) -> Column:
    """ceil(share * n) as a long, the product taken in doubles."""
    return F.ceil(n * F.lit(float(share))).cast("bigint")


def round_half_up(col: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same bits in every IEEE engine."""
    scale = F.lit(float(10 ** digits))
    return F.floor(col * scale + F.lit(0.5)).cast("double") / scale
