"""What chains of links lead to: the root of a tree's nodes, and all nodes that can be reached.

Both work in rounds of equi-joins, each written to the shared folder, so lineage stays short. Chains are halved
in every round, so a tree takes as many rounds as the logarithm of its depth; reaching takes a round for every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import kept


class CycleError(ValueError):
    pass


def roots(links: DataFrame) -> DataFrame:
    """``database``, ``node``, ``root`` and ``depth`` (links up to it) of every node with a ``parent``.

    ``links``: (database, node, parent); a node has one parent. Only nodes that are parents themselves go through the
    rounds, so a parent with very many children is one row until the last join.
    """
    links = kept(links.select("database", "node", "parent").distinct(), "links")
    inner = links.join(links.select("database", F.col("parent").alias("node")).distinct(), ["database", "node"], "left_semi")
    chains = kept(inner.select("database", "node", F.col("parent").alias("root"), F.lit(1).alias("depth")), "chains")
    most = chains.count()
    reach = 1
    while True:
        up = chains.select("database", F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        met = chains.join(up, ["database", "root"], "left")
        if met.where("next IS NOT NULL").isEmpty():
            break
        if reach > most:  # a chain is no longer than there are nodes
            raise CycleError("links go round in a circle")
        further = met.select(
            "database", "node", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        chains, reach = kept(further, "chains"), reach * 2
    above = chains.select("database", F.col("node").alias("parent"), "root", "depth")
    return links.join(above, ["database", "parent"], "left").select(
        "database", "node", F.coalesce("root", "parent").alias("root"), (F.coalesce("depth", F.lit(0)) + 1).alias("depth")
    )


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``database``, ``start`` and ``node``: all nodes that edges lead to from a start, itself included.

    ``edges``: (database, source, target); ``starts``: (database, node). Circles do no harm: a node is followed once.
    """
    edges = kept(edges.select("database", F.col("source").alias("node"), "target").distinct(), "edges")
    found = frontier = kept(starts.select("database", F.col("node").alias("start"), "node").distinct(), "reached")
    while not frontier.isEmpty():
        step = frontier.join(edges, ["database", "node"]).select("database", "start", F.col("target").alias("node")).distinct()
        frontier = kept(step.join(found, ["database", "start", "node"], "left_anti"), "reached")
        found = found.unionByName(frontier)
    return found
