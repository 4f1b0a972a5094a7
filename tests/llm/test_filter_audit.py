"""The filter audit against brute force over documents and orders."""

import itertools
import re

import pytest

from reachspark.llm.filter_audit import audit

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DDL = "doc_id long, text string, source string, part string, bits int"
LABELS = "doc_id long, quality int, toxic int, n int"


def fails(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, text, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        yield i, source or "", (
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            i is not None and least[text] < i,
        )


def brute(rows, labels):
    good = {i for i, q, *_ in labels if q == 1}
    bad = {i for i, _, x, *_ in labels if x == 1}
    docs = list(fails(rows))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, v) for i, p, v in docs if p == part]
        for order in itertools.permutations(range(5)):
            name = "".join("ABCDE"[a] for a in order)
            left = mine
            for step, own in enumerate(order, 1):
                gone = [(i, v) for i, v in left if v[own]]
                left = [(i, v) for i, v in left if not v[own]]
                out[part, name, step] = [
                    len(left),
                    len(gone),
                    sum(v[own] for _, v in mine) - len(gone),
                    sum(v[own] and sum(v) == 1 for _, v in mine),
                    sum(i in good for i, _ in gone),
                    sum(i in bad for i, _ in gone),
                ]
    for part in {p for p, *_ in out}:
        total = [sum(v[1] for (p, name, step), v in out.items() if p == part and name[step - 1] == x) for x in "ABCDE"]
        for (p, name, step), v in out.items():
            if p == part:
                v.append(total["ABCDE".index(name[step - 1])])
    return out


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty texts, copies across parts, repeated ids and rows, long texts, clashing columns."""
    varied = " ".join(f"w{i}" for i in range(260))
    dull = "same words again " * 90
    texts = [None, "", " \n ", varied, varied, varied + " #", dull, dull.upper(), varied.upper() + " $", "É" * 300, varied + " A", "x " * 40_000, varied]
    out = [(i, t, [None, "", "a", "b"][i % 4], "other", 7) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (3, varied, "b", "other", 7), (3, dull, "a", None, None), (None, varied, "a", None, 1), (None, varied, "a", None, 1), (None, None, None, None, None)]


def test_audit_equals_brute_force(spark, rows):
    labels = [(3, 1, 0, 1), (3, 0, 1, 1), (4, 1, 1, 1), (6, 1, None, 1), (8, None, 1, 1), (12, 1, 0, 1), (99, 1, 1, 1), (None, 1, 1, 1)]
    got = audit(spark.createDataFrame(rows, DDL).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(rows, [x for x in labels if x[0] is not None])
    assert len(got) == len(want)
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DDL)
    assert audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    one = audit(spark.createDataFrame([(1, "a", "s", None, 0)], DDL), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and one.where("removed > 0 and filter_order like 'A%' and step = 1").count() == 24
