"""The training-data operators against brute force on small tables with awkward rows."""

import datetime as dt
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reachspark.llm import fuzzy_lines, graph, importance, jaccard, licences, mixing, quality_rules, sharding, templates, textops, token_files, warc
from reachspark.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeimnorstu") for _ in range(r.randint(2, 8))) for _ in range(words)]
    return " ".join(r.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text."""
    base = prose(1, 300)
    other = prose(2, 120)
    texts = [None, "", " \t\n ", "one", "two words", base, base, base.replace(base.split()[40], "changed", 1), other, other.upper(), prose(3, 30_000)]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[5], (5, other + " more", "en", None, 1), (None, base, None, "s1", None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def find(parents, x):
    while parents[x] != x:
        x = parents[x]
    return x


# ---- shared helpers


def test_word_fingerprints_follow_words():
    texts = ["a b  a", None, "", "a b", "é\x0bé\x1cé", "x" * 50_000 + " " + "x" * 50_000]
    raw, offsets = textops.utf8(pa.array(texts))
    starts, ends, first = textops.spans(raw, offsets)
    data = raw.tobytes()
    found = [[data[a:b].decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert found == [WORD.findall(t or "") for t in texts]
    values = textops.fingerprints(raw, starts, ends)
    flat = [w for ws in found for w in ws]
    assert all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(flat, values.tolist()), 2))
    piece, textops.PIECE = textops.PIECE, 16
    try:
        assert np.array_equal(values, textops.fingerprints(raw, starts, ends))
    finally:
        textops.PIECE = piece


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3), (1, None)]
    parents = list(range(200))
    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(parents, a), find(parents, b)))
            parents[y] = x
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
    assert got == {n: find(parents, n) for n in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- token files


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, tokenizer_path(), path, stride=1000)
    files = token_files.read_token_files(spark, path)
    got = token_files.digest(files).orderBy("start").collect()
    assert [x["doc_id"] for x in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    wanted = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    stored = files.collect()
    assert Counter((x["doc_id"], tuple(x["token_ids"])) for x in stored) == wanted
    start = 0
    for x in got:
        assert x["start"] == start
        start += x["n_tokens"]
    crc = Counter((d, zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in wanted.elements())
    assert Counter((x["doc_id"], x["ids_crc32"]) for x in got) == crc
    assert {x["doc_id"] for x in token_files.lookup(spark, path, [3, 8, 999]).collect()} == {3, 8}
    plan = token_files.lookup(spark, path, [3])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    path = str(tmp_path / "none")
    token_files.write_token_files(empty, tokenizer_path(), path)
    assert token_files.digest(token_files.read_token_files(spark, path)).count() == 0


def test_encoder_equals_whole_text_encoding():
    encoder = token_files.Encoder(tokenizer_path())
    texts = ["Don't we'll ÉTÉ ΣΑΣ éa <|endoftext|> a<|startoftext|>b \x1c 12a3 !!! abc... i'm", "İstanbul ß Å ﬀ́ 漢字。", None, "", "the The THE. the,"]
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    whole = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids + [2] for e in whole]
    encoder.by_words = False
    again, _ = encoder.encode(pa.array(texts, pa.string()))
    assert np.array_equal(again, ids)


# ---- fuzzy lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines(spark, empty):
    import xxhash

    line = prose(5, 120)
    words = line.split()
    near = [" ".join([*words[:k], "zz", *words[k + 1 :]]) for k in (3, 50, 90)]
    short = ["Page 1 of 7", "page 1, of 7!", "###", "###", "", "Ω ω"]
    texts = [line + "\n" + short[0], near[0], short[1] + "\n###\n###\n\n" + near[1], near[2] + "\nown line", None, "", line.upper(), "own line\nown line", "a\n" * 300]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y"), (None, "own line", "z")]
    frame = spark.createDataFrame(data, "doc_id long, text string, n_lines string").repartition(2)
    got = fuzzy_lines.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]

    def plain(x):
        return re.sub(r"[\W_]+", " ", x.lower()).strip()

    places = sorted({(-1 if i is None else i, t, n, plain(x)) for i, t, _ in data if t for n, x in enumerate(t.split("\n")) if plain(x)}, key=lambda p: (p[0], p[2]))
    unique = sorted({p[3] for p in places})

    def simhash(x):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in x.split(" ")]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    parents = {x: x for x in unique}
    sims = {x: simhash(x) for x in unique}
    for x, y in itertools.combinations(unique, 2):
        if (sims[x] ^ sims[y]).bit_count() <= 3 and 5 * edit_distance(x, y) <= max(len(x), len(y)):
            parents[find(parents, y)] = find(parents, x)
    keeper = {}
    for i, _, n, x in places:
        keeper.setdefault(find(parents, x), (i, n))
    assert len({find(parents, plain(x)) for x in [line, *near]}) < 4
    for x in got.collect():
        before = {(i, t) for i, t, _ in data if i == x["doc_id"]}
        i, t = -1 if x["doc_id"] is None else x["doc_id"], next(t for _, t in before)
        if not t:
            assert x["text"] == t and x["n_dropped"] == 0 and x["n_lines"] == (0 if t is None else 1)
            continue
        kept = [y for n, y in enumerate(t.split("\n")) if not plain(y) or keeper[find(parents, plain(y))] == (i, n)]
        assert x["text"] == "\n".join(kept) and x["n_dropped"] == len(t.split("\n")) - len(kept)
    assert fuzzy_lines.dedup_lines(empty).count() == 0

def changed_lines(seed, n_words, letters=0, words=0, n=40):
    """Pairs of a line and a copy with changed letters or whole words, all of edit similarity 0.8 or more."""
    r, out = random.Random(seed), []
    while len(out) < n:
        line = " ".join("".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n_words))
        chars = list(line)
        for at in r.sample([i for i, c in enumerate(chars) if c != " "], letters):
            chars[at] = r.choice("0123456789")
        parts = "".join(chars).split(" ")
        for at in r.sample(range(n_words), words):
            parts[at] = "".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in parts[at])
        copy = " ".join(parts)
        if 5 * edit_distance(line, copy) <= max(len(line), len(copy)):
            out.append((line, copy))
    return out


def test_fuzzy_lines_find_short_and_medium_lines(spark):
    kinds = [(5, 1, 0), (10, 1, 0), (10, 0, 1), (20, 1, 0), (20, 3, 0), (20, 0, 2), (30, 1, 0), (30, 0, 3), (50, 5, 0)]
    pairs = [(kind, pair) for k, kind in enumerate(kinds) for pair in changed_lines(k, *kind)]
    data = [(2 * i + j, line) for i, (_, pair) in enumerate(pairs) for j, line in enumerate(pair)]
    dropped = {x["doc_id"] for x in fuzzy_lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect() if x["n_dropped"]}
    assert not any(i % 2 == 0 for i in dropped)
    found = Counter(kind for i, (kind, _) in enumerate(pairs) if 2 * i + 1 in dropped)
    recall = {kind: found[kind] / 40 for kind in kinds}
    print("recall by (words, changed letters, changed words):", recall)
    assert min(recall.values()) >= 0.85 and sum(recall.values()) / len(recall) >= 0.95


def test_simhash_counts_very_long_lines(spark):
    long = spark.createDataFrame([(1, "abc def ghi " * 23_000), (2, "abc def ghi")], "doc_id long, text string")
    found = {x["doc_id"]: x["sim"] for x in fuzzy_lines.occurrences(long).collect()}
    assert found[1] == found[2] != 0


# ---- templates


def test_template_decontamination(spark, empty):
    item = "If Anna buys 12 apples at 3 dollars each and sells them to Berta for 5 dollars apiece, how much does she earn in total that day?"
    again = item.replace("Anna", "Clara").replace("Berta", "Dora").replace("12", "40").replace("5 dollars", "7 euros").replace("3 dollars", "2 euros")
    broken = item.replace("to Berta", "to Anna").replace("Anna", "Berta", 1)
    twisted = "If Anna buys 12 apples at 3 dollars each and Anna sells 12 pears at 9 dollars each and counts the lot"
    mixed = twisted.replace("Anna sells 12", "Dora sells 40")
    benchmark = spark.createDataFrame([(1, item), (2, twisted), (3, None), (4, ""), (5, "Short item of five words"), (6, "...")], "item_id long, text string")
    filler = prose(6, 500)
    texts = [item, filler + " " + item + " " + filler, filler + " " + again, mixed, filler, None, "", "A Short item of five words", filler.upper(), broken]
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, item, 7)], "doc_id long, text string, item_id int")
    got = {(x["doc_id"], x["item_id"]): x for x in templates.find_leaks(frame, benchmark).collect()}
    # the twisted item repeats a name and a number: other values for one of both do not fit
    assert set(got) == {(0, 1), (1, 1), (2, 1), (7, 5), (None, 1)} | ({(9, 1)} & set(got))
    assert got[0, 1]["changed"] == 0 and got[2, 1]["changed"] >= 4
    clean = templates.drop_contaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert {x["doc_id"] for x in clean.collect()} == set(range(10)) - {i for i, _ in got if i is not None}
    assert templates.find_leaks(frame, benchmark.limit(0)).count() == 0 == templates.find_leaks(empty, benchmark).count()
    blocks, templates.BLOCK_CHARS = templates.BLOCK_CHARS, 60
    try:
        assert {(x["doc_id"], x["item_id"]) for x in templates.find_leaks(frame, benchmark).collect()} == set(got)
    finally:
        templates.BLOCK_CHARS = blocks


# ---- licences


def test_parts_and_recased_copies_are_leaks(spark):
    words = [x for x in prose(21, 300).split() if len(x) > 2]
    item = "The " + " ".join(words[:18]) + " with 12 apples. The " + " ".join(words[18:36])
    short = " ".join(words[40:60])
    copies = [
        " ".join(item.split()[:20]), " ".join(item.split()[20:]), item.lower(), item.upper(), item.title(), item.replace(". The", ". A"),
        item.lower().replace("12", "40"), " ".join(short.split()[:10]), " ".join(short.split()[:7]), " ".join(item.split()[:7]),
    ]
    benchmark = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    filler = prose(22, 60)
    docs = spark.createDataFrame([(i, f"{filler} {x} {filler}") for i, x in enumerate(copies)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in templates.find_leaks(docs, benchmark).collect()}
    assert got == {(i, 1) for i in range(7)} | {(7, 2)}
    assert {x["doc_id"] for x in templates.drop_contaminated(docs, benchmark).collect()} == {8, 9}


def test_licence_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.txt", prose(7, 80)),
        ("a/b/y.txt", prose(8, 50) + "\n# " + apache + "\n" + prose(9, 40)),
        ("a/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        ("a/c/d/e/z.txt", prose(10, 60)),
        ("a/c/d/e/z.txt", prose(10, 60)),
        ("f/g.txt", None),
        ("top.txt", ""),
        (None, prose(11, 20)),
    ]
    frame = spark.createDataFrame([(*f, "n") for f in files], "path string, text string, notice string").repartition(2)
    found = licences.scan_licences(frame).collect()
    got = {x["path"]: (x["licence"], x["via"], x["from_dir"]) for x in found}
    assert len(found) == len(files)
    assert got == {
        "a/LICENSE": ("MIT", "header", None),
        "a/b/x.txt": ("MIT", "directory", "a"),
        "a/b/y.txt": ("Apache-2.0", "header", None),
        "a/c/LICENSE": ("GPL-3.0", "header", None),
        "a/c/d/e/z.txt": ("GPL-3.0", "directory", "a/c"),
        "f/g.txt": (None, None, None),
        "top.txt": (None, None, None),
        None: (None, None, None),
    }
    assert licences.scan_licences(frame.limit(0)).count() == 0


def test_licence_texts_headers_and_wrapped_notices(spark):
    texts = dict(licences.full_texts())
    gpl = ["# This program is free software: you can redistribute it and/or modify", "# it under the terms of the GNU General Public License as published by", "# the Free Software Foundation, either version 3 of the License, or", "# (at your option) any later version."]
    code = [prose(30 + i, 9) for i in range(12)]
    files = [(f"{name}/LICENSE", f"Copyright (c) 2024 Jo Doe\n\n{text}") for name, text in texts.items()] + [(f"{name}/src/x.py", prose(50, 30)) for name in texts]
    files += [("h/a.py", "\n".join([*code, *gpl, *code])), ("h/b.py", "\n".join([*code[:5], "Released under", "the MIT License.", *code])), ("h/c.py", prose(51, 30))]
    files += [("n/COPYING", "\n".join([*code, *gpl, *code])), ("n/c.py", prose(52, 30))]
    got = {x["path"]: (x["licence"], x["via"]) for x in licences.scan_licences(spark.createDataFrame(files, "path string, text string")).collect()}
    for name in texts:
        assert got[f"{name}/LICENSE"][0] == name and got[f"{name}/src/x.py"] == (name, "directory")
    assert got["h/a.py"] == ("GPL-3.0", "header") and got["h/b.py"] == ("MIT", "header") and got["h/c.py"] == (None, None)
    assert got["n/COPYING"] == ("GPL-3.0", "header") and got["n/c.py"] == ("GPL-3.0", "directory")


def test_cosines_equal_dense_computation():
    idf = np.random.default_rng(1).uniform(1, 9, licences.BUCKETS)
    made = licences.Templates(licences.TEMPLATES, idf)
    texts = ["under the MIT License we\nReleased under the MIT License.\n\nnothing here", "Licensed under CC BY-NC 4.0.", ""]
    line, bucket, count, first = licences._lines(pa.array(texts))
    at, best, cosine = made.cosines(line, bucket, count, 0.3)
    for x in np.unique(line):
        v = np.zeros(licences.BUCKETS)
        v[bucket[line == x]] = count[line == x] * idf[bucket[line == x]]
        dense = v @ made.weights / np.linalg.norm(v)
        where = np.flatnonzero(at == x)
        assert len(where) == (dense.max() >= 0.3)
        if len(where):
            assert cosine[where[0]] == pytest.approx(dense.max()) and best[where[0]] == dense.argmax()


# ---- sharding


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity_is_minimax(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 30) for _ in range(9)]
    for k in (1, 2, 3, 4, 12):
        best = min(
            max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, 9)))
            for j in range(min(k, 9))
            for cuts in itertools.combinations(range(1, 9), j)
        )
        assert sharding.smallest_capacity(sizes, k) == best


def test_refined_cuts_equal_flat_search(spark):
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(-(1 << 63), 1 << 62, 3000))
    sizes = r.pareto(1.1, len(keys)).astype(int) + 1
    groups = spark.createDataFrame(pd.DataFrame({"key": keys, "size": sizes}))
    for n in (1, 7, 40):
        capacity, cuts = sharding.plan_cuts(groups, n, first_bits=4, next_bits=3)
        assert capacity == sharding.smallest_capacity(sizes.tolist(), n)
        assert np.searchsorted(keys, cuts).tolist() == sharding.greedy(sizes.tolist(), capacity)


@pytest.mark.parametrize("share", [0.0, 0.03, 0.1, 1 / 3])
def test_hot_group_leaves_other_shards_balanced(spark, share):
    r = random.Random(4)
    texts = [f"{i} " + "x" * r.randint(100, 900) for i in range(6000)]
    each = len(texts[0]) + 16
    hot = int(sum(len(t) + 16 for t in texts) * share / (1 - share) / each)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:1] * hot)], "doc_id long, text string")
    got = sharding.shard_documents(frame, 40, first_bits=4, next_bits=3).toPandas()
    bytes_ = got.groupby("shard")["size"].sum().sort_values()
    assert list(sorted(bytes_.index)) == list(range(40))
    others = bytes_.iloc[:-1] if hot else bytes_
    assert others.max() <= 1.25 * others.mean() and others.min() >= 0.75 * others.mean()


def test_shards(spark, docs, rows, empty):
    frame = docs.withColumn("slot", F.lit("clash"))
    got = sharding.shard_documents(frame, 4).toPandas()
    assert len(got) == len(rows) and set(got.columns) == {*frame.columns, "size", "shard"}
    assert (got["size"] == got["text"].map(lambda t: len((t or "").encode()) + 16)).all()
    assert got.groupby(got["text"].fillna("<null>"))["shard"].nunique().max() == 1
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
    assert got["shard"].between(0, 3).all()
    assert sharding.shard_documents(empty, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(docs, 0)


# ---- mixing


def flat_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * share > most * sizes[s]}
        if not full:
            return target | {s: weight[s] * share for s in free}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return target


def test_mixing(spark, docs, rows, empty):
    r = random.Random(9)
    many = [(1000 + i, " ".join(["w"] * r.randint(0, 60)), "en", r.choice(["s0", "s0", "s0", "s1", "t", None]), 0) for i in range(500)]
    frame = docs.unionByName(spark.createDataFrame(many, DDL)).withColumn("copies", F.lit("clash"))
    mixed = mixing.mix(frame, (5, 2, 1), 3)
    got = mixed.toPandas()
    data = rows + many
    assert len(got) == len(data) and (got["size"] == got["text"].map(lambda t: len(WORD.findall(t or "")))).all()
    sizes = Counter()
    for _, t, _, s, _ in data:
        sizes[s] += len(WORD.findall(t or ""))
    wanted = flat_targets(sizes, (5, 2, 1), 3)
    for s, part in got.groupby(got["source"].fillna("<null>")):
        s = None if s == "<null>" else s
        assert part["target"].iloc[0] == pytest.approx(wanted[s]) and part["source_size"].iloc[0] == sizes[s]
        assert abs((part["size"] * part["copies"]).sum() - wanted[s]) <= part["size"].max()
    assert got["copies"].max() <= 3
    again = mixing.mix(frame.repartition(7), (5, 2, 1), 3).toPandas()
    key = ["doc_id", "text", "source", "copies"]
    assert Counter(map(str, got[key].itertuples(index=False))) == Counter(map(str, again[key].itertuples(index=False)))
    assert mixing.draw(mixed).count() == got["copies"].sum()
    assert mixing.mix(empty).count() == 0


def test_budgets_are_nested(spark):
    frame = spark.createDataFrame([(i, "a b c", "en", "s", 5) for i in range(300)], DDL)
    taken = [{x["doc_id"] for x in mixing.mix(frame, (1,), 1, budget).where("copies > 0").collect()} for budget in (90, 300, 600)]
    assert taken[0] < taken[1] < taken[2] and [len(t) for t in taken] == [30, 100, 200]


# ---- importance resampling


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(12)
    pool = prose(13, 300).split()
    text = lambda: [r.choice(pool) for _ in range(r.randint(30, 120))]
    good = [" ".join(text()) for _ in range(150)]
    bad = [" ".join(w + "&&&" for w in text()) for _ in range(60)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(good + bad)], DDL)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    return frame, labels


def test_importance_resampling(spark, graded, empty):
    frame, labels = graded
    odd = spark.createDataFrame([(900, None, "en", "s", 1), (901, "", "en", "s", 1), (3, prose(103, 50), "en", "s", 1)], DDL)
    kept = {x["doc_id"] for x in importance.resample(frame.unionByName(odd), labels).collect()}
    assert len(kept & set(range(150))) >= 147 and len(kept & set(range(150, 210))) <= 2 and not kept & {900, 901}
    assert {x["doc_id"] for x in importance.resample(frame.repartition(5), labels).collect()} == {
        x["doc_id"] for x in importance.resample(frame, labels).collect()
    }
    assert importance.resample(empty, labels).count() == 0
    assert importance.resample(frame, labels.limit(0)).count() >= 209
    stays = importance.keep_sampled(frame, labels)
    assert stays.columns == frame.columns and stays.count() >= 147


def test_gumbel_top_k_is_the_top_k(spark):
    rows = [(i, 1.0, (i * 37 % 100) / 50.0) for i in range(100)]
    weighed = spark.createDataFrame(rows, "doc_id long, good double, log_weight double")
    every = importance.gumbel_top_k(weighed, 100, 0.5).orderBy(F.desc("key")).collect()
    assert len(every) == 100
    some = importance.gumbel_top_k(weighed, 17, 0.5).collect()
    assert {x["doc_id"] for x in some} == {x["doc_id"] for x in every[:17]}
    u = (mixing.HASH_BITS, weighed.select(((mixing.document_hash(F.col("doc_id")) + 0.5) / float(1 << 60)).alias("u")).first()["u"])[1]
    first = next(x for x in every if x["doc_id"] == 0)
    assert first["key"] == pytest.approx(first["log_weight"] / 0.5 - math.log(-math.log(u)))


# ---- quality rules


def test_quality_rules(spark, docs, rows, empty):
    junk = ["SE!! " * 60, "a | b | c " * 30, "the same line\n" * 40, "x y z x y z", "of the " + prose(20, 80) + " of the", "a b c d e\nq\na b c d e"]
    frame = docs.unionByName(spark.createDataFrame([(50 + i, t, "en", "s", 0) for i, t in enumerate(junk)], DDL)).withColumn("kept", F.lit(1))
    got = quality_rules.judge(frame)
    assert "python" not in got._jdf.queryExecution().toString().lower()
    for x in got.collect():
        t = x["text"] or ""
        w = WORD.findall(t)
        three = list(zip(w, w[1:], w[2:]))
        often = Counter(three)
        covered = {j for i, z in enumerate(three) if often[z] > 1 for j in (i, i + 1, i + 2)}
        lines = [y for y in t.split("\n") if WORD.search(y)]
        assert x["n_words"] == len(w) and x["word_chars"] == sum(map(len, w)) and x["n_repeat_words"] == len(covered)
        assert x["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>") and x["n_dup_lines"] == len(lines) - len(set(lines))
        assert x["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (x["kept"] and x["base_failed"])
    kept = {x["doc_id"] for x in got.where("kept").collect()}
    assert 54 in kept and not kept & {50, 51, 52, 53, 55}
    assert quality_rules.judge(empty).count() == 0


# ---- Jaccard join


def shingle_set(text, k):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    parents = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            parents[find(parents, j)] = find(parents, i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            root = find(parents, i)
            least[root] = min(d, least.get(root, d))
    return Counter((d, len(sets[i]), least.get(find(parents, i), d) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_components(spark, rows, empty, k, num, den):
    r = random.Random(k)
    data = [(d, t) for d, t, *_ in rows if d != 5] + [(5, rows[5][1])] * 2
    for g in range(14):
        base = prose(500 + g, r.choice([8, 14, 25, 60, 200, 900]), 3000).split()
        for _ in range(r.randint(2, 9)):
            words = base[:]
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                at = r.randrange(len(words))
                words[at : at + 1] = r.choice([[], ["new"], ["new", words[at]]])
            data.append((100 + len(data), " ".join(words)))
    r.shuffle(data)
    frame = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, component_id int").repartition(4)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(frame, k, num, den).collect())
    assert got == brute_components(data, k, num, den)
    kept = jaccard.one_per_component(frame, k, num, den)
    assert kept.columns == frame.columns
    assert {x["doc_id"] for x in kept.where("doc_id is not null").collect()} == {c for d, _, c in got if d is not None and d == c}
    assert jaccard.jaccard_components(empty).count() == 0


def test_bands_hold_every_partner():
    for num, den in ((90, 100), (80, 100)):
        bands = jaccard.Bands(num, den)
        for size in range(1, 3000):
            for other in (size, size * den // num):
                small, large = bands.of(size), bands.of(other)
                m, spare, most = bands.segments(small)
                assert large - small in (0, 1) and other <= most and spare <= m
                assert (size + other) * (den - num) // (den + num) < m


# ---- revisits


def test_revisits(spark):
    def head(status, **fields):
        return f"HTTP/1.1 {status} X\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + "\r\n"

    at = [dt.datetime(2024, 3, 1) + dt.timedelta(minutes=40 * i) for i in range(12)]
    rows = [
        ("r1", "response", "http://www.A.org:80/x/?b=2&a=1&utm_source=q#f", at[0], head(200, ETag='"1"', Content_Length=5, Vary="a"), "body1"),
        ("v1", "revisit", "https://a.org/x?a=1&b=2", at[1], head(304, ETag='W/"1"', Content_Length=0, Vary="b"), None),
        ("r2", "response", "https://a.org/x?a=1&b=2", at[3], head(200, ETag='"2"'), "body2"),
        ("e2", "response", "https://a.org/x?a=1&b=2", at[4], head(503), "down"),
        ("v2", "revisit", "a.org/x", at[4], head(304), None),
        ("v3", "revisit", "https://a.org/x?a=1&b=2", at[9], head(304, ETag='"1"'), None),
        ("v4", "revisit", "https://a.org/x?a=1&b=2", at[0], head(304, ETag='"1"'), None),
        ("v5", "revisit", "https://a.org/x?a=1&b=2", at[10], head(304), None),
        ("r6", "response", "http://b.org/", at[0], head(200, Last_Modified="d"), "b"),
        ("v6", "revisit", "http://b.org", at[11], head(304, Last_Modified="d", ETag='"n"'), None),
        ("v7", "revisit", None, at[5], head(304), None),
        ("v8", "revisit", "http://b.org", None, None, None),
        ("m1", "metadata", "http://b.org", at[1], None, None),
    ]
    ddl = "record_id string, warc_type string, target_uri string, date timestamp, http string, payload string"
    frame = spark.createDataFrame([*rows, rows[1]], ddl).withColumn("verdict", F.lit(1))
    found = warc.resolve_revisits(frame, stretch_seconds=3600).collect()
    got = {x["record_id"]: (x["prior"], x["verdict"], x["payload"]) for x in found}
    assert len(found) == 9
    assert got == {
        "v1": ("r1", "resolved", "body1"),
        "v2": (None, "missing", None),
        "v3": ("r2", "mismatch", None),
        "v4": (None, "missing", None),
        "v5": ("r2", "unverified", None),
        "v6": ("r6", "resolved", "b"),
        "v7": (None, "missing", None),
        "v8": (None, "missing", None),
    }
    merged = next(x["head"] for x in found if x["record_id"] == "v1")
    assert merged == {"etag": 'W/"1"', "content-length": "5", "vary": "b"}
    for width in (1, 10**6):
        again = warc.resolve_revisits(frame, stretch_seconds=width).collect()
        assert {x["record_id"]: (x["prior"], x["verdict"], x["payload"]) for x in again} == got
    assert warc.resolve_revisits(frame.limit(0)).count() == 0
