"""Cases that once crashed or passed in silence."""

import numpy as np
import pytest

from reachspark.llm import importance, jaccard, mixing, sharding


def test_mix_takes_columns_named_like_its_helpers(spark):
    rows = [(i, "w " * (i % 5), "ab"[i % 2], "r", "t", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rounds string, threshold string, h long")
    got = mixing.mix(docs)
    assert got.count() == 40 and {"rounds", "threshold", "h"} <= set(got.columns)
    assert {(x["rounds"], x["threshold"]) for x in mixing.draw(got).collect()} == {("r", "t")}
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    assert sorted((x["doc_id"], x["copies"]) for x in got.collect()) == sorted((x["doc_id"], x["copies"]) for x in plain.collect())


@pytest.mark.parametrize("shift", [5.0, -1e6])
@pytest.mark.parametrize("k", [20, 300])
def test_top_k_far_from_zero(spark, shift, k):
    """k of n come back whatever the weights, those with the largest keys."""
    rows = [(i, shift + i / 1000.0) for i in range(100)]
    weighed = spark.createDataFrame(rows, "doc_id long, log_weight double")
    got = importance.gumbel_top_k(weighed, k, 0.002).collect()
    assert len({x["doc_id"] for x in got}) == len(got) == min(k, 100)
    rest = importance.gumbel_top_k(weighed, 100, 0.002).collect()
    kept = {x["doc_id"] for x in got}
    assert min(x["key"] for x in got) >= max([x["key"] for x in rest if x["doc_id"] not in kept], default=float("-inf"))


def test_shards_join_counts_without_shuffling_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(300)], "doc_id long, text string")
    got = sharding.shard_documents(docs, 7)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    slots = {}
    for x in got.collect():
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_copies_without_ids_and_ids_with_two_texts(spark):
    """Identity is the row, not the id: rows without one link, and an id's two texts are two documents."""
    words = [f"w{i}" for i in range(200)]
    base, near = " ".join(words), " ".join(words[:100] + ["new"] + words[101:])
    alone, pair = " ".join(f"a{i}" for i in range(90)), [f"p{i}" for i in range(120)]
    rows = [(7, base), (None, near), (None, near), (3, alone), (3, base + " tail"), (None, " ".join(pair)), (None, " ".join(pair[:-1] + ["q"]))]
    rows += [(None, None), (None, ""), (9, " "), (9, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    got = sorted((x["doc_id"] or -1, x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(docs, 5, 80, 100).collect() if x["n_shingles"])
    assert got == [(-1, 116, None), (-1, 116, None), (-1, 196, 3), (-1, 196, 3), (3, 86, 3), (3, 197, 3), (7, 196, 3)]
    kept = jaccard.one_per_component(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    left = [(x["doc_id"], x["text"]) for x in kept.collect()]
    named = sorted(x for x in left if x[0] is not None)
    assert named == [(3, alone), (3, base + " tail"), (9, " "), (9, " ")]
    nameless = [t for i, t in left if i is None and (t or "").strip()]
    assert len(nameless) == 1 and nameless[0].startswith("p0 ")
    assert sum(i is None for i, _ in left) == 3


@pytest.mark.parametrize("num", [80, 90])
def test_sketches_rule_out_no_link(spark, num):
    """Pairs with a link pass the sketches, most others do not; a sketch never differs more than its sets."""
    r = np.random.default_rng(num)
    sets = []
    for n in (1, 2, 9, 40, 300, 2000, 20_000):
        one = r.integers(0, 2**63, n).astype(np.uint64)
        for change in (0, 1, n // 20, n // 9, n // 5, n):
            sets.append(np.unique(np.concatenate((one[change:], r.integers(0, 2**63, change // 2).astype(np.uint64)))))
    rows, close = [], set()
    for i, a in enumerate(sets):
        rows.append((i, len(a), *jaccard.sketch(a).tolist()))
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            bits = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
            assert bits <= len(a) + len(b) - 2 * both
            if 100 * both >= num * (len(a) + len(b) - both):
                close.add((j, i))
    sketches = spark.createDataFrame(rows, "node long, n_shingles long, " + ", ".join(f"{p} long" for p in jaccard.SKETCH))
    pairs = spark.createDataFrame([(j, i) for i in range(len(sets)) for j in range(i)], "a long, b long")
    left = {(x["a"], x["b"]) for x in jaccard._near_sketches(pairs, sketches, num, 100).collect()}
    assert close <= left and len(left) < len(close) + 40


@pytest.mark.parametrize("few, at_a_time", [(1, 7), (32, 400_000)])
def test_groups_are_the_same_by_hubs_and_by_pairs(spark, monkeypatch, few, at_a_time):
    """Whatever meets directly and however texts are dealt out, the links are those of brute force."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "AT_A_TIME", at_a_time)
    rng, rows = np.random.default_rng(3), []
    base = [f"w{i}" for i in range(120)]
    for i in range(30):
        at, words = int(rng.integers(0, 90)), list(base)
        words[at : at + int(rng.integers(5, 30))] = [f"n{i}"]
        rows.append((i, " ".join(words)))
    sets = {i: set(zip(*[t.split()[j:] for j in range(3)])) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = {n: min(a, b) if g in (a, b) else g for n, g in group.items()}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100)
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == group


def test_folded_sketches_never_exceed_the_difference(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate((a[20:], rng.integers(0, 1 << 62, 15).astype(np.uint64)))
    rows = [(i, *(int(x) for x in jaccard.sketch(np.unique(s)))) for i, s in enumerate((a, b))]
    table = spark.createDataFrame(rows, "i long, " + ", ".join(f"{p} long" for p in jaccard.SKETCH))
    x, y = (list(r) for r in table.orderBy("i").select(*jaccard._folded()).collect())
    bits = sum(bin((p ^ q) & ((1 << 64) - 1)).count("1") for p, q in zip(x, y))
    assert 0 < bits <= 35 and (35 - bits) % 2 == 0
