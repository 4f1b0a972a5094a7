"""Connected components of a table of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step on edges ``(u, v)`` with ``u > v``."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    joined = both.join(least, "u")
    if large:
        joined = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        joined = moved.unionByName(least.select("u", F.col("least").alias("v")))
    return joined.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, component)``: the smallest node that is reachable.

    Only nodes with a link to another node come back; NULLs, loops and repeated links are ignored. A step
    shuffles the links once; minima are combined before the shuffle and a hub is only ever
    joined, so adaptive execution splits it. Rounds grow with the logarithm of the longest path.
    """
    edges = (
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = cut(edges)
    mark = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        found = edges.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
        ).first()
        if (found["n"], found["sum"]) == mark:
            break
        mark = (found["n"], found["sum"])
    labelled = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return labelled.unionByName(roots)
