"""From shared keys to components: verify few pairs per bucket, then only pairs between components.

A bucket is the set of nodes with one key. All pairs of a bucket are candidates, but the aim is
connectivity, so a bucket's most widely shared node is verified against the others first. Once
these links are contracted, only pairs whose ends still lie in different components can matter;
they are verified in the second round. No link between two components is lost, and a bucket of
thousands of near copies costs as many pairs as it has nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.llm.graph import components
from reachspark.llm.scratch import release
from reachspark.session import cut


def link_components(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    across: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``node, component`` of all nodes with a verified link.

    ``members(key, node, missing, probe, exact)`` has distinct nodes per key; ``missing`` counts
    the keys that a node shares with nobody, so the middle of a group has the least. A pair is a
    candidate if one of the two probes and one is exact. ``verify`` takes ``(a, b)`` pairs and
    returns those that are linked. The second round asks ``across`` for the pairs to verify; it gets
    the members of parted buckets with ``component``, whether they are a ``stranger`` to the bucket's largest component, the bucket's
    counts of ``probers`` and ``strangers`` and one ``hub`` per bucket, a central node of its group; all pairs between components are the default. Buckets are combined before each shuffle and otherwise only
    joined, which adaptive execution may split; no bucket is gathered in a row.
    """
    rank = F.struct("probe", "exact", (-F.col("missing")).alias("shared"), "node")
    middle = F.struct((-F.col("missing")).alias("shared"), "node")
    leaders = members.groupBy("key").agg(F.max(rank).alias("l"), F.max(middle).alias("m"), F.count("*").alias("n"))
    led = members.join(leaders, "key")
    joined = led.where("node != l.node and (probe or l.probe) and (exact or l.exact)")
    first = cut(joined.select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct())
    near = cut(verify(first))
    release(members.sparkSession)
    labels = components(near)

    # a bucket without a node that probes, or without a whole segment, holds no candidates
    now = led.where("n > 2 and l.probe and l.exact").drop("l", "n")
    now = now.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parted = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.sum(F.col("probe").cast("int")).alias("probers"))
    now = cut(now.join(parted.where("x != y").select("key", "probers"), "key"))
    # buckets off the middle of a group take over the hub that their own most central node has elsewhere
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"))
    now = now.join(tops.select("key", F.col("top.component").alias("top"), (F.col("n") - F.col("top.n")).alias("strangers")), "key")
    now = now.withColumn("stranger", F.col("component") != F.col("top")).drop("top")
    near_hubs = now.select(F.col("m.node").alias("node")).distinct()
    best = led.join(near_hubs, "node").groupBy("node").agg(F.max("m")["node"].alias("hub"))
    best = cut(best.withColumnRenamed("node", "near_hub"))
    now = cut(small_join(now.withColumn("near_hub", F.col("m.node")).drop("m"), best, "near_hub"))
    release(members.sparkSession)
    pairs = (across or _all_across)(now)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = cut(verify(pairs.join(tried, ["a", "b"], "left_anti")))
    release(members.sparkSession, now, first, best)
    return components(near.unionByName(rest))


def _all_across(now: DataFrame) -> DataFrame:
    left, right = now.alias("p"), now.alias("q")
    across = left.join(
        right,
        (F.col("p.key") == F.col("q.key"))
        & (F.col("p.node") < F.col("q.node"))
        & (F.col("p.component") != F.col("q.component"))
        & (F.col("p.probe") | F.col("q.probe"))
        & (F.col("p.exact") | F.col("q.exact")),
    )
    return across.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))


def small_join(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", rows: int = 500_000) -> DataFrame:
    """Join a table that is already written; it is broadcast only if counted to at most ``rows`` rows."""
    return big.join(F.broadcast(small) if small.count() <= rows else small, on, how)
