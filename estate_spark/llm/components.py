"""Connected components of an edge table, as DataFrame joins and aggregates only.

Distributed union-find by alternating stars: every node links its larger neighbours to its
smallest one, then its smaller ones; each round roughly squares how far a label travels, so
the number of rounds is logarithmic in a component's diameter. Nothing is collected but two
numbers a round (the edges' count and a checksum, to see that nothing moves any more). Minima
combine before the shuffle, so a node with very many neighbours sends one row a task, and the
join that hands its minimum back is an equi-join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate_spark.session import written


def _state(edges: DataFrame) -> tuple:
    low = F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF)
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(low), F.lit(0))).first())


def _stars(pairs: DataFrame) -> DataFrame:
    """a, b, and the smallest b (or a itself) of every a as ``least``."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    return pairs.join(least.withColumn("least", F.least("a", "least")), "a")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (columns a, b): root is the component's smallest
    node. Null ends and loops are no edges; without edges the result is empty."""
    edges = (edges.filter("a is not null and b is not null and a <> b")
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = written(edges, "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # large: every edge goes from a node to one below it
        stars = _stars(large)
        small = stars.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        edges = written(small, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
