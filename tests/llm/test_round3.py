"""Findings of round 3: what a task holds while it works."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reachspark.llm import importance, jaccard, linking


class _Ratio:
    value = np.linspace(-1.0, 1.0, importance.BUCKETS)


def _batch():
    texts = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(2000)) for i in range(1200)]
    return pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts), pa.nulls(1200, pa.int32())], names=["doc_id", "text", "good"])


def test_scoring_holds_the_words_of_a_small_piece_only():
    batch = _batch()
    list(importance._scores(_Ratio)(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(importance._scores(_Ratio)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == 1200 and peak < 60 << 20
    # pieces do not change what a text scores
    one = next(importance._scores(_Ratio)(iter([batch.slice(700, 1)])))
    assert np.isclose(found["log_weight"][700].as_py(), one.column(3)[0].as_py(), rtol=1e-12)


def test_alike_differences_meet_about_once_a_pair():
    """A pair that shares many shingles beyond its hub is made a few times, not once a shingle."""
    hub = [f"w{i}" for i in range(400)]
    texts = [" ".join(hub[:250] + [f"new{i}" for i in range(90)] + [f"own{t}"] + hub[300:]) for t in range(3)]
    sets = list(jaccard.shingle_sets(pa.array([" ".join(hub), *texts]), 5))
    keys = [jaccard.set_key(s) for s in sets]
    batch = pa.RecordBatch.from_pydict({"a": [keys[0]] * 3, "b": keys[1:], "text_a": [" ".join(hub)] * 3, "text_b": texts})
    rows = [x for b in jaccard._differences(5, 80, 100)(iter([batch])) for x in b.to_pylist() if x["is_new"]]
    met = [(x["node"], y["node"], bool(set(x["before"]) & set(y["before"]))) for x in rows for y in rows if x["shingle"] == y["shingle"] and x["node"] < y["node"]]
    made = [pair[:2] for pair in met if not pair[2]]
    assert len(set(made)) == len({pair[:2] for pair in met}) == 3  # no pair is lost
    assert len(met) > 100 and len(made) <= 6


def test_buckets_are_told_by_their_probing_members(spark):
    """A long bucket that two members probe is no large one: it costs two pairs a member."""
    rows = [(1, n, 0, n < 2, True) for n in range(100)]
    members = spark.createDataFrame(rows, "key long, node long, missing long, probe boolean, exact boolean")
    seen = []

    def across(parted):
        seen.extend(parted.select("key", "node", "probers").collect())
        return parted.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)

    linking.link_components(members, lambda pairs: pairs.limit(0), across)
    assert len(seen) == 100 and {x["probers"] for x in seen} == {2}


def test_a_set_sends_no_more_differences_than_a_partner_needs():
    """At most H + 1 rows a set, about half of its differences beside a far partner, and no linked pair is lost."""
    rng, num, den = np.random.default_rng(7), 80, 100
    hub = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        words = list(hub)
        for at in rng.choice(290, int(rng.integers(1, 14)), replace=False):
            words[at] = f"n{rng.integers(0, 40)}" if i % 2 else f"own{i}"
        del words[5 : 5 + int(rng.integers(0, 60))]
        texts.append(" ".join(words + [f"end{i}"]))
    base, *sets = jaccard.shingle_sets(pa.array([" ".join(hub), *texts]), 5)
    keys = [jaccard.set_key(s) for s in (base, *sets)]
    batch = pa.RecordBatch.from_pydict({"a": [keys[0]] * 60, "b": keys[1:], "text_a": [" ".join(hub)] * 60, "text_b": texts, "component": list(range(60))})
    sent, far, rows = {}, {}, 0
    for x in (x for b in jaccard._differences(5, num, den)(iter([batch])) for x in b.to_pylist()):
        assert keys[1 + x["component"]] == x["node"]
        sent.setdefault(x["component"], set()).add((x["is_new"], x["shingle"]))
        far[x["component"]] = x["far"]
        rows += 1

    def links(s, t):
        both = len(np.intersect1d(s, t))
        return den * both >= num * (len(s) + len(t) - both)

    linked = 0
    for i, s in enumerate(sets):
        most = (len(s) + len(s) * den // num) * (den - num) // (den + num)
        apart = len(base) + len(s) - 2 * len(np.intersect1d(base, s))
        assert far[i] != links(base, s)
        assert len(sent[i]) <= (most + 1 if far[i] else apart - apart * num // (den + num) // 2)
        for j in range(i):
            if (far[i] or far[j]) and links(s, sets[j]):
                linked += 1
                assert sent[i] & sent[j]
    assert linked > 20 and 5 < sum(far.values()) < 55 and rows == sum(map(len, sent.values()))


def test_buckets_tell_members_outside_their_largest_component(spark):
    """A long bucket of one group and a stranger costs one pair a member, however many probe it."""
    rows = [(1, n, 0, True, True) for n in range(100)]
    members = spark.createDataFrame(rows, "key long, node long, missing long, probe boolean, exact boolean")
    seen = []

    def across(parted):
        seen.extend(parted.collect())
        return parted.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)

    linking.link_components(members, lambda pairs: pairs.where("a != 7 and b != 7"), across)
    assert len(seen) == 100 and {(x["probers"], x["strangers"]) for x in seen} == {(100, 1)}
    assert [x["node"] for x in seen if x["stranger"]] == [7]
