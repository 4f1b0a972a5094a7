"""The Elias-Fano trie against plain search, and language-model scores against a dictionary of counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reachspark.llm import ef_trie as T
from reachspark.llm import lm_scoring as L
from reachspark.session import cut

DDL = "doc_id long, text string, block long, score string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=300), st.integers(0, 60))
def test_increasing_sequence(values, shift):
    v = np.sort(np.array([x >> shift for x in values], np.int64))
    e = T.Increasing(T.from_buffer(T.to_bytes(T.ef_arrays(v))))
    assert e.access(np.arange(len(v))).tolist() == v.tolist()
    v = np.unique(v)
    e = T.Increasing(T.ef_arrays(v))
    ask = np.concatenate((v, v + 1, v - 1))
    place = {x: i for i, x in enumerate(v.tolist())}
    a, b = np.zeros_like(ask), np.full_like(ask, len(v))
    assert e.find(ask, a, b).tolist() == [place.get(x, -1) for x in ask.tolist()]
    half = len(v) // 2
    assert e.find(ask, a, a + half).tolist() == [p if (p := place.get(x, -1)) < half else -1 for x in ask.tolist()]


@pytest.mark.parametrize("words", [2, 9, 70])
def test_trie_finds_what_it_holds(words):
    r = np.random.default_rng(words)
    grams = np.unique(r.integers(0, words, (900, 3)), axis=0)
    arrays, _ = T.trie_arrays(list(grams.T))
    trie = T.Trie(T.from_buffer(T.to_bytes(arrays)), "", 3)
    ask = np.concatenate((grams, r.integers(-1, words + 3, (2000, 3))))
    place = {tuple(g): i for i, g in enumerate(grams.tolist())}
    assert trie.find(list(ask.T))[2].tolist() == [place.get(tuple(g), -1) for g in ask.tolist()]


def test_codes_round_down():
    p = np.concatenate(([1.0, 0.0], np.random.default_rng(0).random(1000) ** 9))
    back = T.decoded(T.quantise(p))
    assert (back <= p * (1 + 1e-9)).all() and (back >= p * 0.9993 - 1e-16).all()


def brute(rows, order, discount=0.75):
    """Interpolated absolute discounting by counting in dictionaries."""
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]) for i, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in docs]
    counts = [defaultdict(Counter) for _ in range(order)]
    for (_, words), out in zip(docs, held, strict=True):
        if not out:
            full = ["<s>"] * (order - 1) + words
            for i in range(order - 1, len(full)):
                for k in range(order):
                    counts[k][tuple(full[i - k : i])][full[i]] += 1
    known = counts[0][()]
    n, v = sum(known.values()), len(known)
    result = []
    for (i, words), out in zip(docs, held, strict=True):
        full, base, score = ["<s>"] * (order - 1) + words, 0.0, 0.0
        for at in range(order - 1, len(full)):
            p = (known[full[at]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(1, order):
                after = counts[k].get(tuple(full[at - k : at]))
                if after:
                    total = sum(after.values())
                    p = max(after[full[at]] - discount, 0) / total + discount * len(after) / total * p
            score += math.log10(p)
        result.append((i, out, len(words), sum(known[w] > 0 for w in words), n, base, score))
    return result


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, repeated rows and ids, odd white space, clashing columns."""
    r = random.Random(3)
    pool = ["".join(r.choice("aeklmrst") for _ in range(r.randint(1, 5))) for _ in range(300)]
    texts = [" ".join(r.choice(pool[: r.choice((20, 300))]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    texts += [None, "", "\t \n", "One ONE one\x0bone\xa0one", texts[3], texts[3].upper(), "the " * 20_000, "Äé ß x" * 30]
    out = [(i * 7 - 5, t, i, "x") for i, t in enumerate(texts)]
    return [*out, out[4], (2, "another text", None, None), (None, texts[5], 1, "y"), (None, None, None, None)]


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(g[:5]) for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-12)
        # codes round down by 0.00025 in log10 at most, twice an order
        assert w[6] - 0.0006 * w[2] <= g[6] <= w[6] + 1e-9


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, rows, order):
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    close(L.score_corpus(docs, order, block_bytes=2000, shard_bytes=9000).collect(), brute(rows, order))


def test_kept_model_scores_alike(spark, rows):
    docs = spark.createDataFrame(rows, DDL).repartition(2)
    blocks = cut(L.tokenise(docs, 3000))
    model = L.train(blocks, 7, 3)
    want = brute(rows, 3)
    close(L.score(blocks, model).collect(), want)
    other = spark.createDataFrame([(r[0], r[1]) for r in rows[:9]], "doc_id long, text string")
    close(L.score(L.tokenise(other), model).collect(), want[:9])


def test_model_beats_word_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["held_out"]: r for r in L.score_corpus(docs).groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).collect()}
    assert got[True]["sum(score)"] > 0.8 * got[True]["sum(base_score)"]


def test_nothing_to_score_or_learn(spark):
    assert L.score_corpus(spark.createDataFrame([], DDL)).count() == 0
    held = next(i for i in range(100) if L.held_out(i))
    got = L.score_corpus(spark.createDataFrame([(held, "a b", 1, "")], DDL)).collect()
    assert [tuple(r[:5]) for r in got] == [(held, True, 3, 0, 0)] and got[0]["score"] == pytest.approx(0)
