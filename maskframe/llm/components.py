"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written_to


def _is_settled(edges: DataFrame) -> bool:
    """Whether every component is a star: no node has two smaller neighbours, or one above and one below it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 or up = 1 and down = 1").count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node that has an edge to another.

    ``edges`` has ``a`` and ``b``, of one ordered type, in any direction; loops and repeats do no harm,
    rows with a null are no edges. Each round is two aggregates that combine before they shuffle
    and two joins, written to the shared folder; the number of rounds grows with the logarithm of the
    longest path, and no node's edges meet in one task. It ends once all components are stars.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct()
    spark = edges.sparkSession
    edges, folder = written_to(edges, "edges")
    while not _is_settled(edges):
        old = folder
        edges, folder = written_to(_small_star(_large_star(edges)).distinct(), "edges")
        release(spark, old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
