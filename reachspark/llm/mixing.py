"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit hash. A source that should give a fraction of its words gives the
documents below a threshold, so smaller budgets take subsets of larger ones and no row is sorted.
The threshold comes from histograms: words per source and hash bucket, then only the bucket in
which the budget ends is divided again, until that bucket holds a single hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.llm.textops import n_words
from reachspark.session import cut

HASH_BITS = 60
LEVEL_BITS = 12


def document_hash(doc_id: Column, seed: int = 0) -> Column:
    """The first 60 bits of the MD5 of ``seed:doc_id``; NULL ids hash as ``seed:``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], most: float, budget: float | None = None) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share the budget (all
    words if not given). A target stops at ``most`` times its source; the excess goes to the
    others by weight until none is above. This is the level at which weights times it, cut off
    at the limits, add up to the budget; it is found from the order of limit per weight. One row per
    source meets in one window; sources number far less than documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    total = F.sum("source_size").over(everything).cast("double") if budget is None else F.lit(float(budget))
    rows = rows.withColumn("total", total).withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, here_on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # level if all sources of smaller ratio are at their limits
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(here_on)
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    found = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("found", found)
    target = F.when(F.col("found").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("found")))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, threshold`` so that the words with a hash below come nearest to ``wanted``.

    ``sizes(source, h, size)``, ``wanted(source, wanted)``. Every level aggregates by source and
    bucket with map-side combining, at most 4096 buckets per source, and passes on only the rows
    of the bucket in which the budget ends. Documents with one hash fall on one side together.
    """
    state = wanted.select("source", "wanted", F.lit(0).cast("long").alias("low"), F.lit(0.0).alias("taken"))
    left = HASH_BITS
    while left > 0:
        left -= LEVEL_BITS
        here = sizes.alias("s").join(state.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        inside = F.shiftright(F.col("s.h"), left + LEVEL_BITS) == F.shiftright(F.col("t.low"), left + LEVEL_BITS)
        buckets = (
            here.where(inside)
            .groupBy(F.col("s.source").alias("source"), F.shiftright("s.h", left).alias("bucket"))
            .agg(F.sum("s.size").alias("size"))
        )
        joined = buckets.alias("b").join(state.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        joined = joined.select("b.source", "b.bucket", "b.size", "t.wanted", "t.taken")
        by_bucket = Window.partitionBy("source").orderBy("bucket")
        joined = joined.withColumn("upto", F.col("taken") + F.sum("size").over(by_bucket))
        # the last bucket that begins at or below the budget
        starts = F.col("upto") - F.col("size")
        last = F.max_by(F.struct("bucket", starts.alias("taken"), "size"), "bucket")
        ends = joined.where(starts <= F.col("wanted")).groupBy("source").agg(last.alias("x"), F.first("wanted").alias("wanted"))
        state = cut(
            ends.select(
                "source", "wanted", F.shiftleft("x.bucket", left).alias("low"),
                F.col("x.taken").alias("taken"), F.col("x.size").cast("double").alias("size"),
            )
        )
    # the last hash of the budget is in or out, whichever comes nearer
    whole = F.col("taken") + F.col("size") - F.col("wanted") < F.col("wanted") - F.col("taken")
    return state.select("source", F.when(whole, F.col("low") + 1).otherwise(F.col("low")).alias("threshold"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, budget: float | None = None, seed: int = 0) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, copies``.

    ``size`` is the number of words (NULL: 0), ``copies`` how often the mix takes the document:
    the whole rounds of its source's target, plus one if its hash lies below the source's
    threshold. No document is taken more than ``most`` rounded up times. A NULL source is a source;
    a source without words has target 0. Rows that share an id share a hash, so repeated rows
    are taken together. Input columns named like the four new ones are replaced. An empty table
    gives no rows. Runs agree: hashes depend on ids alone. A hot source is combined before each
    shuffle; the final join brings one row per source to the documents and may be split.
    """
    rows = docs.drop("size", "source_size", "target", "copies").withColumn("size", n_words(F.col("text")))
    slim = cut(rows.select("source", document_hash(F.col("doc_id"), seed).alias("h"), "size"))
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = cut(targets(per_source, weights, most, budget))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("rounds", rounds.cast("long"))
    plan = plan.withColumn("wanted", F.col("target") - F.col("rounds") * F.col("source_size"))
    limits = thresholds(slim, plan.select("source", "wanted"))
    plan = plan.alias("p").join(limits.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    plan = plan.select(F.col("p.source").alias("source__"), "source_size", "target", F.col("rounds").alias("rounds__"), F.col("threshold").alias("threshold__"))
    joined = rows.join(cut(plan), rows["source"].eqNullSafe(F.col("source__")))
    once_more = F.when(document_hash(F.col("doc_id"), seed) < F.coalesce(F.col("threshold__"), F.lit(0)), 1).otherwise(0)
    return joined.withColumn("copies", (F.col("rounds__") + once_more).cast("int")).drop("source__", "rounds__", "threshold__")


def draw(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of the documents."""
    extra = ["size", "source_size", "target", "copies"]
    taken = mixed.where("copies > 0").withColumn("round__", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.drop("round__", *extra)
