"""Connected components of links between numbers, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modsieve.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour or itself."""
    pairs = _both_ways(edges)
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(smallest, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(smallest, "u").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node with a link; ``links`` has ``a`` and ``b``.

    Large stars and small stars in turn until nothing moves; the number of rounds grows with the logarithm of the number
    of nodes.  Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.
    The minimum per node is combined before the shuffle, and its join with the pairs is one adaptive execution can split.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        edges = materialize(_small_star(_large_star(edges)), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
