"""Gradient boosting that held rows stop, for the squared and for the pinball loss.

Features are cut into bins once; rows then lie as bin numbers and as what each model still misses
(``treegrow``), one part a core or a million rows. A round of all models together is a job a level of
the trees, where tasks count rows and gradients a bin, and one for the steps: for the squared loss the
leaf means, which the counts hold; for the pinball loss the exact quantile of each leaf's residuals, read
from the few values around its place that each task sends, and asked again where those don't reach. What
is missed lies in Spark's cache after each round and in a written table after each block of rounds, so a
lost executor repeats one block at most. The held rows' loss is measured for every round; after
``patience`` rounds without a smaller one a model ends, and the trees up to the best round stay (one at
least). What the driver holds follows from rounds, depth, bins and leaves.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_spark.functions import treegrow
from estate_spark.operators import ranks
from estate_spark.session import scratch_path, written

cloudpickle.register_pickle_by_value(treegrow)      # executors need no copy of this package

LIMIT, PATIENCE = 2000, 50       # fixed values
BLOCK = 10                       # rounds between two written tables
RATE, DEPTH, LEAST_ROWS = 0.1, 6, 20
UNHELD_ROUNDS = 100              # without held rows nothing stops the rounds
PART_ROWS, FEW_ROWS = 1_000_000, 25_000     # most rows of a part; fewer of them cost less than one more task
WIDTH = 6.0                      # of the first windows around a quantile, in standard deviations of its place
FEW_PARTS = 32                   # answers that the driver adds up itself
HELD, LEAF = "_held", "_leaf"
CHUNKS = "part long, rows long, fit long, codes binary, miss binary"
NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


@dataclass
class Boosted:
    trees: GBTRegressionModel            # the kept trees behind a constant one, weights included
    base: float
    steps: list[list[float]] | None      # tree -> leaf -> step of a quantile; the trees hold them too
    rate: float
    best: int                            # round of the smallest held loss
    curve: list[float]                   # held loss after 0, 1, ... rounds

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the prediction as column ``out``."""
        return predict(df, **{out: self.trees})


def _nodes(spark: SparkSession, model: GBTRegressionModel) -> dict:
    """Columns of the nodes of the model's trees, read from its own saved tables: their size is set by the
    training parameters, not by the data."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        F.col("treeID").alias("tree"), "id", "prediction", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.col("split.leftCategoriesOrThreshold").alias("values"), F.col("split.numCategories").alias("kinds"))
    return rows.toArrow().sort_by([("tree", "ascending"), ("id", "ascending")]).to_pydict()


def predict(df: DataFrame, **models: GBTRegressionModel) -> DataFrame:
    """``df`` with the sum of each model's weighted trees as a column of the name given. One narrow pass:
    Arrow batches go through the trees in NumPy, whose size follows from the training parameters."""
    spark, named = df.sparkSession, list(models.items())
    features, vector = named[0][1].numFeatures, named[0][1].getFeaturesCol()
    nodes = together(*[partial(_nodes, spark, m) for _, m in named])
    # pickled by value: a broadcast object would need this package on executors
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(treegrow.Forest(features, nodes, [list(m.treeWeights) for _, m in named])))
    names = [out for out, _ in named]

    @F.pandas_udf(", ".join(f"{out} double" for out in names))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forest = pickle.loads(shared.value)
        for b in batches:
            x = np.stack(b.to_numpy()) if len(b) else np.zeros((0, features))
            yield pd.DataFrame(dict(zip(names, forest.predictions(x))))

    return df.withColumn("_scores", run(vector_to_array(F.col(vector)))).select(*df.columns, "_scores.*")


def predict_steps(df: DataFrame, trees: GBTRegressionModel, base: float, steps: list[list[float]], rate: float, out: str) -> DataFrame:
    """base + rate * the sum of the steps of the leaves that a row falls into: for stored models whose
    trees don't hold the steps."""
    leaves = trees.setPredictionCol("_unused").setLeafCol(LEAF).transform(df)
    one = df.sparkSession.createDataFrame([(steps,)], "steps array<array<double>>").scalar()
    # the first leaf is that of the constant tree
    own = F.zip_with(F.slice(vector_to_array(F.col(LEAF)), 2, len(steps)), F.col("_steps"), lambda leaf, s: F.get(s, leaf.cast("int")))
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return leaves.withColumn("_steps", one).withColumn(out, F.lit(base) + F.lit(rate) * total).drop("_unused", LEAF, "_steps")


def loss(label: Column, score: Column, alpha: float | None) -> Column:
    """Squared error, or the pinball loss of the quantile ``alpha``."""
    miss = label - score
    return miss * miss if alpha is None else F.greatest(F.lit(alpha) * miss, F.lit(alpha - 1.0) * miss)


def rounds_left(curve: list[float], patience: int) -> int | None:
    """None while boosting goes on; the best round once ``patience`` rounds brought nothing."""
    best = 0
    for r, value in enumerate(curve):
        if value < curve[best]:
            best = r
        elif r - best >= patience:
            return best
    return None


@dataclass
class _Model:
    alpha: float | None
    base: float
    curve: list[float] = field(default_factory=list)
    trees: list[list[tuple]] = field(default_factory=list)      # nodes as Spark ML saves them
    steps: list[list[float]] = field(default_factory=list)
    best: int | None = None
    on: bool = True


def together(*builds):
    """Results of independent fits, run side by side: their many small jobs fill the cluster."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(b) for b in builds]]


def _layout(table: DataFrame, features: int, nominal: dict[int, int], max_bins: int) -> treegrow.Layout:
    """The bins of all features: thresholds from all fitted rows' values, a bin a level of a category."""
    numeric = [f for f in range(features) if f not in nominal]
    points = max(2048, 4 * max_bins)
    cuts: list = [None] * features
    if numeric:
        found = table.filter(~F.col(HELD)).select("_x").mapInArrow(
            partial(treegrow.summaries, features=features, numeric=numeric, points=points), "found binary")

        def together(rows):
            parts = [pickle.loads(r[0]) for r in rows]
            return [treegrow.merged(parts, points=max(points, treegrow.POINTS))] if parts else []

        parts = found.rdd.repartition(8).mapPartitions(together).collect()
        for f, (values, weights) in zip(numeric, treegrow.merged(parts)):
            cuts[f] = treegrow.cuts_of(values, weights, max_bins)
    return treegrow.Layout(cuts, [nominal[f] if f in nominal else len(cuts[f]) + 1 for f in range(features)])


def _ask(chunks: RDD, run, add, **asked):
    """The tasks' answers added up: by the driver, or in a tree of tasks where they are many."""
    found = chunks.mapPartitions(partial(treegrow.answer, run=run, **asked))
    return reduce(add, found.collect()) if found.getNumPartitions() <= FEW_PARTS else found.treeReduce(add)


def _grown(chunks: RDD, layout: treegrow.Layout, models: list[tuple[int, _Model]], first: list, depth: int, least_rows: int) -> list[treegrow.Grown]:
    """A tree a model (its row of ``miss``, itself), level by level, from the root's counts."""
    trees, counts = [treegrow.Grown(layout) for _ in models], dict(enumerate(first))
    for _ in range(depth):
        for i, c in counts.items():
            trees[i].grow(*c, least_rows)
        going = [i for i in counts if trees[i].edge]
        if not going or trees[going[0]].depth == depth:
            break
        asked = [(models[i][0], models[i][1].alpha, trees[i].walk(), *trees[i].slots()) for i in going]
        counts = dict(zip(going, _ask(chunks, treegrow.count_codes, treegrow.summed, layout=layout, asked=asked)))
    return trees


def _quantile_steps(chunks: RDD, models: list[tuple[int, _Model]], trees: list[treegrow.Grown]) -> list[list[float]]:
    """Per model the quantile of the residuals in each of its tree's leaves, exact."""
    leaves = [t.leaves() for t in trees]
    steps: list[dict[int, float]] = [{} for _ in trees]
    width = WIDTH
    while any(len(s) < len(own) for s, own in zip(steps, leaves)):
        open_ = [i for i, own in enumerate(leaves) if len(steps[i]) < len(own)]
        asked = []
        for i in open_:
            number = np.full(len(trees[i].nodes), -1, dtype=np.intp)
            number[leaves[i]] = np.arange(len(leaves[i]))
            asked.append((models[i][0], models[i][1].alpha, trees[i].walk(), number, len(leaves[i]),
                          [k for k in range(len(leaves[i])) if k not in steps[i]], width))
        for i, found in zip(open_, _ask(chunks, treegrow.windows, treegrow.joined, asked=asked)):
            parts: dict[int, list] = {}
            for f in found:
                parts.setdefault(f[0], []).append(f)
            for k, own in parts.items():
                value = treegrow.quantile_of(own, models[i][1].alpha)
                if value is not None:
                    steps[i][k] = value
        width *= 8
    return [[s[k] for k in range(len(s))] for s in steps]


def _ensembles(spark: SparkSession, models: list[_Model], rate: float, vector: str, features: int) -> list[GBTRegressionModel]:
    """The kept trees behind a constant one as models of Spark ML: the files of a constant model, with
    its trees' nodes, are read back."""
    from pyspark import SparkContext
    stump = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=0).fit(spark.createDataFrame([(Vectors.sparse(features, [], []), 0.0)], ["x", "y"]))
    sc = SparkContext._active_spark_context
    kind = sc._jvm.org.apache.spark.ml.regression
    array, numbers = sc._gateway.new_array(kind.DecisionTreeRegressionModel, 1), sc._gateway.new_array(sc._jvm.double, 1)
    array[0], numbers[0] = stump._java_obj, 1.0
    path = scratch_path(spark, "constant")
    GBTRegressionModel(kind.GBTRegressionModel("boosted", array, numbers, features)).write().save(path)
    about = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    tree = json.loads(spark.read.parquet(f"{path}/treesMetadata").first()[1])

    def build(m: _Model) -> GBTRegressionModel:
        path, trees = scratch_path(spark, "boosted"), m.trees[:m.best]
        constant = (0, m.base, -1.0, [0.0, 0.0, 0.0], sum(r[4] for r in trees[0] if r[6] < 0), -1.0, -1, -1, (-1, [], -1))
        own = about | {"uid": f"boosted_{uuid.uuid4().hex[:12]}", "numTrees": len(trees) + 1, "paramMap": {"featuresCol": vector}}
        spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(i, json.dumps(tree | {"uid": f"tree_{uuid.uuid4().hex[:12]}", "paramMap": {"featuresCol": vector}}), rate if i else 1.0)
                               for i in range(len(trees) + 1)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame([(i, r) for i, rows in enumerate([[constant], *trees]) for r in rows], NODES).coalesce(1).write.parquet(f"{path}/data")
        return GBTRegressionModel.load(path)

    return together(*[partial(build, m) for m in models])


def _train(stored: DataFrame, parts: int, layout: treegrow.Layout, models: list[_Model], held: int, rate: float, depth: int, least_rows: int,
           limit: int, patience: int) -> None:
    """The rounds of ``models``, until each has ended."""
    def read(stored: DataFrame, bases: list[float] | None = None) -> RDD:
        return stored.rdd.map(treegrow.keyed).partitionBy(parts, int).values().map(partial(treegrow.unpacked, kind=layout.dtype, bases=bases))

    spark, chunks = stored.sparkSession, read(stored, [m.base for m in models]).persist(StorageLevel.MEMORY_AND_DISK)
    lies = list(range(len(models)))                            # the models of ``miss``
    root = (0, np.zeros(1, dtype=np.intp), np.zeros((1, 1), dtype=np.uint8)), np.zeros(1, dtype=np.intp), 1
    before, done, whole = None, 0, None                        # whole: all rows by bin, the same in every round
    while True:
        on = [(lies.index(i), m) for i, m in enumerate(models) if m.on and (held or len(m.trees) < limit)]
        if not on:
            break
        growing = [(k, m) for k, m in on if len(m.trees) < limit]
        losses, first = _ask(chunks, treegrow.first_counts, treegrow.summed, layout=layout, asked=[(k, m.alpha, *root, whole is not None) for k, m in growing],
                             held=[(k, m.alpha) for k, m in on] if held else [])
        if first:
            whole = first[0][0] if whole is None else whole
            first = [(whole, *c[1:]) for c in first]
        if before is not None:
            before.unpersist()
        for (_, m), value in zip(on, losses):
            m.curve.append(value / held)
            m.best = rounds_left(m.curve, patience)
            m.on = m.best is None and len(m.trees) < limit
        left = [i for i, (_, m) in enumerate(growing) if m.on]
        growing, first = [growing[i] for i in left], [first[i] for i in left]
        trees = _grown(chunks, layout, growing, first, depth, least_rows) if growing else []
        for (_, m), t in zip(growing, trees):
            m.on = len(t.nodes) > 1 or not m.trees             # else no split lowers the loss any more
        pairs = [(k, m, t) for (k, m), t in zip(growing, trees) if m.on]
        if not pairs:
            continue
        asked = [(k, m, t) for k, m, t in pairs if m.alpha is not None]
        exact = iter(_quantile_steps(chunks, [(k, m) for k, m, _ in asked], [t for *_, t in asked]))
        moves, keep = [], []
        for k, m, t in pairs:
            leaves = t.leaves()
            steps = [t.nodes[i]["s"] / t.nodes[i]["n"] for i in leaves] if m.alpha is None else next(exact)
            own = dict(zip(leaves, steps))
            m.trees.append(t.rows(own))
            m.steps.append(steps)
            moves.append((len(keep), t.walk(), rate * np.array([own.get(i, 0.0) for i in range(len(t.nodes))])))
            keep.append(k)
        before, done = chunks, done + 1
        chunks = chunks.map(partial(treegrow.moved, moves=moves, keep=keep))
        lies = [lies[k] for k in keep]
        if done % BLOCK == 0:
            chunks = read(written(spark.createDataFrame(chunks.map(treegrow.packed), CHUNKS, verifySchema=False), "boost-rows"))
        chunks = chunks.persist(StorageLevel.MEMORY_AND_DISK)
    chunks.unpersist()


def boost(rows: DataFrame, label: str, vector: str, held: Column, alpha: float | None = None, **params) -> Boosted:
    """Boosted trees for the mean (``alpha`` None) or a quantile of ``label``, see ``boost_all``."""
    return boost_all(rows, label, vector, held, [alpha], **params)[0]


def boost_all(rows: DataFrame, label: str, vector: str, held: Column, alphas: list[float | None], max_bins: int = 32, rate: float = RATE,
              depth: int = DEPTH, least_rows: int = LEAST_ROWS, limit: int = LIMIT, patience: int = PATIENCE) -> list[Boosted]:
    """A model an entry of ``alphas``, fitted on rows that aren't ``held``. Rows without a label or
    on neither side are not read."""
    spark, y = rows.sparkSession, F.col(label)
    attrs = rows.schema[vector].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    nominal = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attrs}
    wide = [a.get("name", a["idx"]) for a in attrs if nominal[a["idx"]] > max_bins]
    if wide:
        raise ValueError(f"more levels than {max_bins} bins: {wide}")
    table = rows.select(vector_to_array(F.col(vector)).alias("_x"), y.cast("double").alias(label), F.coalesce(held, F.lit(False)).alias(HELD)).filter(y.isNotNull())
    size = table.agg(F.count_if(~F.col(HELD)).alias("fit"), F.count_if(HELD).alias("held"), F.avg(F.when(~F.col(HELD), y)).alias("mean"), F.max(F.size("_x")).alias("features")).first()
    if not size["fit"]:
        raise ValueError("no rows to fit")
    qs = sorted({a for a in alphas if a is not None})
    found = ranks.quantile_rows(table.filter(~F.col(HELD)), [label], qs, small=size["fit"] <= ranks.SMALL_ROWS).first() if qs else None
    models = [_Model(a, float(size["mean"] if a is None else found[2 + qs.index(a)])) for a in alphas]
    layout = _layout(table, size["features"], nominal, max_bins)
    total = size["fit"] + size["held"]
    parts = max(-(-total // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-total // FEW_ROWS)))
    stored = written(table.repartition(parts).mapInArrow(partial(treegrow.encoded, features=size["features"], layout=layout), CHUNKS), "boost-rows")

    limit = limit if size["held"] else min(limit, UNHELD_ROUNDS)
    _train(stored, parts, layout, models, size["held"], rate, depth, least_rows, limit, patience)
    for m in models:
        if m.best is None:
            m.best = min(range(len(m.curve)), key=m.curve.__getitem__) if m.curve else len(m.trees)
        m.best = max(m.best, 1)
    return [Boosted(trees, m.base, m.steps[:m.best] if m.alpha is not None else None, rate, m.best, m.curve)
            for m, trees in zip(models, _ensembles(spark, models, rate, vector, size["features"]))]
