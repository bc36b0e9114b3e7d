"""Connected components by contraction, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); a component's name is its smallest node.

    Each round points every node to the smallest of itself and its neighbours, replaces the ends of all edges by what
    they point to and drops those within one node. The smallest node of a component points to itself, so it is what is left. Rounds are as
    the logarithm of the longest path; each is written to the shared folder. Frequent nodes are only aggregated on or joined on.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    names: DataFrame | None = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        to = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "points")
        moved = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        after = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if names is None:
            names = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), "to")
            names = names.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        names, old = cut(names, "names"), names
        drop_cut(old)
        drop_cut(left)
        drop_cut(to)
        left = after
    return left.select(F.col("a").alias("node"), F.col("b").alias("component")) if names is None else names
