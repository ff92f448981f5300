"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.session import cut_lineage


def _summary(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of `edges`; the component is its least node.

    Repeated edges count once; loops and edges with a null end join nothing. Each round sends a node's larger
    neighbours, then its smaller ones, to its least neighbour, and ends when no edge changes any more: then every edge
    leads from a node to the least node of its component. A hub is aggregated map-side first, and its edges meet its
    minimum in a plain equality join, which Spark splits when it is skewed. Rounds are cut by reliable checkpoints.
    """
    a, b = F.col(left), F.col(right)
    edges = cut_lineage(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, now = None, _summary(edges)
    while now != before and now[0]:
        sides = edges.select("u", "v").union(edges.select("v", "u"))
        least = sides.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("m"))
        large = (
            sides.filter(F.col("v") > F.col("u"))
            .join(least, F.col("u") == F.col("node"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("node")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("node", "m")).distinct())
        before, now = now, _summary(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
