"""Connected components of a large edge table, without a neighbour list in any one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.session import settle


def _pull_larger(edges: DataFrame) -> DataFrame:
    """Tie the larger neighbours of each node to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter(
        "a <> b").distinct()


def _pull_smaller(edges: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").union(
        least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge; the label is the least node reachable.

    Edges are columns ``a`` and ``b``. Every round works by minimum and join, so a node with very
    many neighbours is pre-aggregated and split like any hot key. Rounds: about the logarithm of
    the longest path.
    """
    edges = settle(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        edges = settle(_pull_smaller(_pull_larger(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
                edges.select("b", "b").distinct())
        state = now
