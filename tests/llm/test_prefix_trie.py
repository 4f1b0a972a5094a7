"""The prefix trie against a dictionary of prefixes, and tree contraction against recursion."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from reachspark.llm import prefix_trie as P

DDL = "conv_id long, turn long, role string, text string, node string, depth int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in sorted(convs.items()):
        h = zlib.crc32(str(c).encode()) % 9
        full = convs.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append(c)
        ends[tuple(full)].append(c)
    out = {}
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1].encode()) if n else 0
    for n, who in members.items():
        text = ",".join(map(str, ends[n])) if n in ends else ""
        out[who[0], len(n)] = (members[n[:-1]][0] if n else None, len(who), children[n], leaves[n], saved[n], hashlib.sha256(text.encode()).hexdigest())
    return out


def check(spark, rows, parts=4):
    got = P.prefix_trie(spark.createDataFrame(rows, DDL).repartition(parts)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == want


def conversation(c, turns, extra=()):
    return [(c, i, ("user", "assistant")[i % 2], t, "x", 1) for i, t in enumerate(turns)] + list(extra)


def test_trie_equals_brute_force(spark):
    """NULLs, ties and repeated rows, missing bases, turnless and negative ids, clashing columns."""
    r = random.Random(5)
    rows = []
    for c in [*range(0, 60), *range(203, 260, 7), -3, -10, 10**12, 10**12 + 1]:
        stem = ["hello", "what", "now", "then"][: r.randint(1, 4)]
        rows += conversation(c, stem + [r.choice("abcdé") for _ in range(r.randint(0, 9))])
    rows += [(7, None, None, None, None, None), (7, 3, "user", "tie", None, None), (7, 3, "user", "tie", None, None), (8, 3, "assistant", "tie", "y", 2)]
    rows += [(None, 1, "user", "nobody", None, None), (61, 0, "user", None, None, None), (63, 0, None, "", None, None)]
    check(spark, rows)


def test_long_and_common_conversations(spark):
    """One conversation far longer than a partition, and hundreds of equal ones."""
    rows = conversation(4, [f"turn {i}" for i in range(300)])
    for c in range(10, 200):
        rows += conversation(c, ["same", "same", "same"] if c % 3 else ["same", f"own {c}", "more", "and more"])
    check(spark, rows, 7)


def test_no_conversations(spark):
    assert P.prefix_trie(spark.createDataFrame([], DDL)).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "c", 1)], DDL)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_contraction_of_trees(spark, shape):
    n, r = 120, random.Random(shape)
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: r.randrange(i), "caterpillar": lambda i: i - 1 if i % 2 else max(i - 2, 0)}[shape]
    parent = [None] + [up(i) for i in range(1, n)]
    value = [r.randint(0, 9) for _ in range(n)]
    total, kids = value[:], Counter(parent)
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    rows = [((i, 0), None if p is None else (p, 0), kids[i], v) for i, (p, v) in enumerate(zip(parent, value, strict=True))]
    nodes = spark.createDataFrame(rows, "node struct<a:long,b:long>, up struct<a:long,b:long>, n_children long, v long")
    got = {x["node"]["a"]: x["v"] for x in P.subtree_totals(nodes, ["v"]).collect()}
    assert got == dict(enumerate(total))
