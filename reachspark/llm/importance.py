"""Quality selection by importance resampling.

Two generative models of hashed word n-grams are counted: one of target texts (documents labelled
good), one of all raw text. A document's log weight is the log ratio of the two probabilities of
its n-grams, as a mean per n-gram so that length does not decide, shrunk for very short texts.
A Gumbel variable is added and the ``k`` largest sums are kept, which samples without
replacement in proportion to the weights; the temperature says how strictly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.llm.linking import small_join
from reachspark.llm.mixing import HASH_BITS, document_hash, thresholds
from reachspark.llm.textops import LOWER, fingerprints, mix, pieces, spans, utf8
from reachspark.session import cut

BUCKETS = 1 << 14
#: n-grams worth of ratio 1 that every text is credited with.
PRIOR = 10.0
#: Steps into which the range of the keys is cut to find the k-th largest.
_STEPS = float(1 << 50)


def hashed_ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and the offsets of each text's own."""
    raw, offsets = utf8(column)
    starts, ends, first = spans(raw, offsets)
    words = fingerprints(raw, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    pairs = mix(words[:-1] + np.uint64(0x632BE59BD9B4E019)) + words[1:] if len(words) else words
    inner = doc[:-1] == doc[1:] if len(words) else np.zeros(0, bool)
    values = np.concatenate((mix(words), mix(pairs[inner])))
    owner = np.concatenate((doc, doc[:-1][inner] if len(words) else doc))
    order = np.argsort(owner, kind="stable")
    buckets = (values[order] % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.concatenate(([0], np.cumsum(n + np.maximum(n - 1, 0))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in pieces(batches, "text"):
        buckets, offsets = hashed_ngrams(batch.column(0))
        good = np.repeat(np.asarray(batch.column(1).fill_null(False)), np.diff(offsets))
        raw += np.bincount(buckets, minlength=BUCKETS)
        target += np.bincount(buckets[good], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents ``doc_id, good, fits``, chosen by a hash of the id.

    One half fits the target model, the other half sets the cut, so that the cut is taken where
    the model has not seen the texts, as with all other documents. NULL ids and labels are left
    out; a document with labels of both kinds counts as not good.
    """
    half = F.pmod(document_hash(F.col("doc_id"), 8), F.lit(2)) == 0
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return rows.orderBy(document_hash(F.col("doc_id"), 7), "doc_id").limit(most).select("doc_id", F.col("good").cast("int"), half.alias("fits"))


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability per bucket; 16 384 sums over all documents."""
    rows = docs.join(F.broadcast(sample), "doc_id", "left").select("text", (F.col("fits") & (F.col("good") == 1)).alias("target"))
    parts = rows.mapInArrow(_counts, "bucket long, raw long, target long")
    table = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = table["bucket"].to_numpy(np.int64)
    raw[at] += table["raw"].to_numpy(float)
    target[at] += table["target"].to_numpy(float)
    # add-one smoothing of the target follows the raw model, so unseen n-grams are neutral
    prior = raw / raw.sum()
    smoothed = (target - 1 + prior * BUCKETS) / target.sum()
    return np.log(smoothed / prior).astype(np.float64)


def _scores(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in pieces(batches, "text"):
            buckets, offsets = hashed_ngrams(batch.column(1))
            sums = np.concatenate(([0.0], np.cumsum(table[buckets])))
            n = np.diff(offsets)
            score = (sums[offsets[1:]] - sums[offsets[:-1]]) / (n + PRIOR)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(score, mask=n == 0)],
                names=["doc_id", "good", "n_ngrams", "log_weight"],
            )

    return run


def weigh(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """``doc_id, good, n_ngrams, log_weight`` per row; ``good`` is the label of held-out documents.

    Texts without words, NULL texts included, have no weight. The sample of at most
    ``most_labels`` labelled ids is broadcast; the counts cover all texts whole.
    """
    sample = labelled_sample(labels, most_labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(rows, sample))
    held_out = sample.where("not fits").select("doc_id", "good")
    marked = rows.join(F.broadcast(held_out), "doc_id", "left").select("doc_id", "text", "good")
    return cut(marked.mapInArrow(_scores(ratio), "doc_id long, good int, n_ngrams long, log_weight double"))


def dividing_weight(weighed: DataFrame, good_weight: float = 3.0) -> float:
    """Weight above which held-out labelled documents are best told apart.

    A good document lost counts ``good_weight`` times as much as a bad one kept, as shares of their kinds.

    Reads the held-out half of the sample alone, which is bounded. Without labels of both kinds the cut is 0.
    """
    sample = weighed.where("good is not null and log_weight is not null").select("good", "log_weight").toPandas()
    good, bad = (np.sort(sample["log_weight"][sample["good"] == x].to_numpy()) for x in (1, 0))
    if not len(good) or not len(bad):
        return 0.0
    edges = np.unique(np.concatenate((good, bad)))
    middle = (edges[:-1] + edges[1:]) / 2 if len(edges) > 1 else edges
    accuracy = good_weight * (1 - np.searchsorted(good, middle) / len(good)) + np.searchsorted(bad, middle) / len(bad)
    best = np.flatnonzero(accuracy >= accuracy.max() - 1e-12)
    return float(middle[best[len(best) // 2]])


def gumbel_top_k(weighed: DataFrame, k: int, temperature: float, seed: int = 0) -> DataFrame:
    """The rows with the ``k`` largest ``log_weight / temperature + Gumbel``, with that ``key``.

    The variable comes from a hash of the id, so runs agree and rows with one id and weight stand
    or fall together. The k-th largest is found by refining histograms between the measured ends of the
    keys; nothing is sorted.
    """
    u = (document_hash(F.col("doc_id"), seed) + 0.5) / float(1 << HASH_BITS)
    rows = weighed.where("log_weight is not null").withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(u)))
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    if ends["high"] is None:
        return rows
    span = (ends["high"] - ends["low"]) or 1.0
    rows = rows.withColumn("rank", F.floor((F.lit(ends["high"]) - F.col("key")) / F.lit(span) * _STEPS).cast("long"))
    spark = weighed.sparkSession
    one_group = F.when(F.col("rank").isNotNull(), "all")
    sizes = rows.select(one_group.alias("source"), F.col("rank").alias("h"), F.lit(1).cast("long").alias("size"))
    wanted = spark.range(1).select(F.lit("all").alias("source"), F.lit(float(k)).alias("wanted"))
    found = thresholds(sizes, wanted).first()
    limit = found["threshold"] if found else 0
    return rows.where(F.col("rank") < F.lit(limit)).drop("rank")


def resample(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, temperature: float = 0.002, k: int | None = None) -> DataFrame:
    """``doc_id, n_ngrams, log_weight, key`` of the documents that are kept.

    Without ``k`` as many are drawn as have a weight above the one that best divides the labelled
    sample. Texts without words are never drawn. Repeated rows are drawn together; an empty
    table, or no labels at all, is legal: weights are then all equal and all texts with words stay.
    """
    weighed = weigh(docs, labels, most_labels)
    if k is None:
        k = weighed.where(F.col("log_weight") >= F.lit(dividing_weight(weighed))).count()
    return gumbel_top_k(weighed, k, temperature).drop("good")


def keep_sampled(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns."""
    drawn = cut(resample(docs, labels, **options).select("doc_id").distinct())
    return small_join(docs, drawn, docs["doc_id"].eqNullSafe(drawn["doc_id"]), "left_semi")
