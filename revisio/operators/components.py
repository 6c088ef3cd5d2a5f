"""Connected components of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisio.plans.lineage import dropped, written


def components(links: DataFrame, *, node: str = "node", key: str = "key") -> DataFrame:
    """``(node, component)`` for a table of ``(node, key)``: nodes that share a key, directly or through others, are one component.

    A component is named by its least node.  Each key first ties its nodes to
    its least one; then large and small stars alternate: every node ties its
    greater neighbours, then its lesser ones, to the least of them, until each
    component is one star.  That takes a number of rounds that grows with the
    logarithm of a component's size, however long its chains are.  Minima are
    partial sums, so a key that a third of all nodes share is no hot spot; each
    round's edges are written to the shared folder and the round's before
    deleted.  Null keys link nothing.
    """
    named = links.select(F.col(node).alias("node"), F.col(key).alias("key")).where("key is not null and node is not null")
    e = written(named, "links")
    least = e.groupBy("key").agg(F.min("node").alias("v"))
    # "least" is no endpoint of an edge to itself: u > v holds for all edges
    edges = written(e.join(least, "key").where("node > v").select(F.col("node").alias("u"), "v").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(to, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "edges")
        dropped(large, edges)
        edges = new
    alone = e.select("node").distinct()
    return alone.join(edges, alone["node"] == edges["u"], "left").select(F.col("node").alias(node), F.coalesce("v", "node").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none of its own kind."""
    more = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    on = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").limit(1)
    return more.count() == 0 and on.count() == 0
