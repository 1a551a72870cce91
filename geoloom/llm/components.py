"""Connected components of an edge table, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the smallest node among it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = common.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    linked = both.join(low, "u")
    linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = common.written(linked.where("u != v").distinct())
    common.dropped(low)
    return out


def _done(edges: DataFrame) -> bool:
    """Whether every node has one smaller node, which has none: the forest is one star for each component."""
    n = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (n or 0) <= 1 and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (u, v), which are long; label is the smallest node of its component.

    An edge table without rows gives none; loops and repeated edges change nothing. Every round is written, joins are
    on one node with its minimum, so a node with very many neighbours is dealt out by skew handling.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    now = common.written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _done(now):
        first = _stars(now, True)
        after = _stars(first, False)
        for x in (first, now):
            common.dropped(x)
        now = after
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
