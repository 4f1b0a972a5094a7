"""Exact Jaccard self-join of documents on word shingles by partitioning the universe of shingles.

Sets of similar size form a band; a partner of a set in band ``k`` lies in bands ``k - 1`` to
``k + 1``. For the pairs of bands ``k`` and ``k`` or ``k + 1``, two sets that link differ in at most ``H`` shingles, so
with shingles hashed into ``m = H + 1`` segments at least one segment holds the same shingles in
both. Some spare segments are also indexed under each of their one-deletion neighbours, which
finds partners that differ there by one shingle and so counts twice in the pigeonhole sum. With
this credit every set skips its longest buckets (empty segments, frequent passages): a segment
costs 1, a spare segment 2, one neighbour of it 1. There are as many spare segments as the number of
empty segments to expect. What meets in a bucket is verified on the whole sets, unless the parity sketches of
two sets already differ in more bits than sets that link differ in shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.llm.linking import link_components, small_join
from reachspark.llm.scratch import release
from reachspark.llm.textops import LOWER, WORD, fingerprints, mix, pieces, shingles, spans, utf8
from reachspark.session import cut


#: Words of a set's sketch: bit ``h mod 1024`` is the parity of its shingles with that hash. Every shingle that one of two sets
#: lacks flips one bit, so sketches differ in at most as many bits as the sets differ in shingles.
SKETCH = [f"p{i}" for i in range(16)]
#: The same sketch folded to 256 bits for rows that are joined many times: parities add up, so its bound is exact too.
FOLDED = [f"f{i}" for i in range(4)]

#: Probing members of a bucket, or members outside its largest component, up to which its pairs between components meet
#: directly: its members times so many at most. A meeting compares four words; a difference from a hub needs both texts.
FEW = 256
#: Smaller shingles of its set that a row of a difference carries, and smaller keys of its node that a member carries.
EARLIER = 6
#: Pairs whose texts are joined at a time.
AT_A_TIME = 400_000


class Bands:
    """Size bands, segments per band and spare segments for the threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def of(self, size: int) -> int:
        while self.edges[-1] <= size:
            b = self.edges[-1]
            self.edges.append(max(b + 1, b * self.den // self.num + 1))
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def segments(self, band: int) -> tuple[int, int, int]:
        """Segments, spare segments and the largest partner for pairs whose smaller set is in ``band``."""
        while len(self.edges) <= band + 1:
            self.of(self.edges[-1])
        small = self.edges[band + 1] - 1
        large = small * self.den // self.num
        differ = (small + large) * (self.den - self.num) // (self.den + self.num)
        m = differ + 1
        empty = m * math.exp(-self.edges[band] / m)
        return m, min(m, math.ceil(1.15 * empty + 3 * math.sqrt(empty) + 1)), large


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, ASCII letters lower-cased."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    starts, ends, first = spans(raw, offsets)
    words = fingerprints(raw, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(shingles(words[a:b], k))


def set_key(values: np.ndarray) -> int:
    """A signed 64-bit value of a set."""
    scrambled = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    total = np.array([scrambled.sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64)
    return int(mix(mix(total) + np.bitwise_xor.reduce(scrambled)).view(np.int64)[0])


def sketch(values: np.ndarray) -> np.ndarray:
    """The parity sketch of a set as 64-bit words."""
    bit = (mix(values ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(64 * len(SKETCH))).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=64 * len(SKETCH)) & 1).astype(bool)).view(np.int64)


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), k))
            node = [set_key(s) if len(s) else None for s in sets]
            words = np.array([sketch(s) for s in sets])
            columns = [batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64())]
            columns += [pa.array(words[:, i]) for i in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "node", *SKETCH])

    return run


def signatures(values: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Keys of one set for both band pairs it belongs to: ``keys, band, spares and kinds``.

    Kind 0 is a whole segment, 1 a whole spare segment, 2 a spare segment less one shingle.
    """
    own = bands.of(len(values))
    parts = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    for band in (own, own - 1):
        if band < 0:
            continue
        m, spare, large = bands.segments(band)
        if m == 1 or len(values) > large:
            continue
        segment = (mix(values + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(parts[order], dtype=np.uint64)))
        ends = np.searchsorted(segment[order], np.arange(m + 1))
        totals = sums[ends[1:]] - sums[ends[:-1]]
        place = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40) + np.uint64(1))
        keys, kinds = [mix(totals + place)], [np.where(np.arange(m) < spare, 1, 0)]
        for j in range(spare):
            inside = parts[order[ends[j] : ends[j + 1]]]
            keys.append(mix(totals[j] - inside + place[j]))
            kinds.append(np.full(len(inside), 2))
        kind = np.concatenate(kinds).astype(np.int64)
        yield np.concatenate(keys).view(np.int64), band, kind + 4 * spare


def _signature_rows(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        seen: set[int] = set()
        for batch in pieces(batches, "text"):
            keys, nodes, metas = [], [], []
            for values in shingle_sets(batch.column(0), k):
                if not len(values) or (node := set_key(values)) in seen:
                    continue
                seen.add(node)
                signed = list(signatures(values, bands))
                whole = sum(int(np.count_nonzero(kind & 3 != 2)) for _, _, kind in signed)
                for key, band, kind in signed:
                    keys.append(key)
                    nodes.append(np.full(len(key), node, np.int64))
                    metas.append((whole << 24) + (band << 16) + kind)
            if keys:
                columns = [np.concatenate(x) for x in (keys, nodes, metas)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "meta"])

    return run


def _linked(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(pieces(iter([whole]), "text_a"), "text_b"):
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                keep = []
                for x, y, s, t in zip(a, b, shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    similar = den * both >= num * (len(s) + len(t) - both)
                    keep.append(similar and set_key(s) == x and set_key(t) == y)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``; ``row`` tells rows apart that differ in id or text, NULLs included."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("text", "doc_id"))


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs(doc_id, text)``.

    Documents link if ``den * intersection >= num * union`` of their distinct k-word shingles;
    a text of fewer words is one shingle. ``component_id`` is the smallest id reachable. Texts
    without words, NULL texts included, link with nothing and keep their own id. Rows without
    an id link like others and get their group's smallest id, NULL if no row of it has one. Rows with
    one id but different texts are separate documents. Equal sets are one node with the least of their ids,
    so exact copies are never paired; a partition sends each set's signatures once. Other columns are ignored.
    An empty table gives no rows. Sets are compared by 64-bit fingerprints.
    """
    sets, nodes = _nodes(docs, k, num, den)
    least = nodes.groupBy("component").agg(F.min("rep.doc_id").alias("least"))
    labels = nodes.join(least, "component").select("node", F.col("least").alias("label"))
    found = sets.join(labels, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))


def _nodes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, n_shingles, node`` of all rows, and ``node, rep, component`` of all sets with a word.

    A node is a set's key. ``rep`` is its first row, ordered by (no id, id, row); ``component`` is the
    smallest node it is linked with, or itself.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must lie in (0, 1]")
    rows, spark = _rows(docs), docs.sparkSession
    release(spark)
    schema = "doc_id long, row long, n_shingles long, node long, " + ", ".join(f"{p} long" for p in SKETCH)
    sets = cut(rows.mapInArrow(_summaries(k), schema))
    first_row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    reps = sets.where("node is not null").groupBy("node").agg(F.min(first_row).alias("rep"))
    known = sets.where("node is not null").groupBy("node").agg(*[F.min(c).alias(c) for c in ("row", "n_shingles", *SKETCH)])

    signed = rows.select("text").mapInArrow(_signature_rows(k, num, den), "key long, node long, meta long")
    in_bucket = Window.partitionBy("key")
    marked = signed.withColumns(
        {"x": F.min("node").over(in_bucket), "y": F.max("node").over(in_bucket), "length": F.count("*").over(in_bucket)}
    )
    shared = cut(marked.where("x != y").select("key", "node", "meta", "length"))
    del signed, marked
    release(spark)
    members = cut(_allocated(shared))
    release(spark, shared)

    needed = cut(members.select("node").distinct().join(known, "node"))
    texts = cut(small_join(rows.select("row", "text"), needed.select("node", "row"), "row").select("node", "text"))
    if texts.count() > needed.count():  # rows that are repeated whole
        texts = cut(texts.groupBy("node").agg(F.first("text").alias("text")))
    release(spark)

    def on_texts(pairs: DataFrame, step, schema: str) -> DataFrame:
        """``step`` on the texts of all pairs, so many pairs at a time that only texts they need are shuffled."""
        pairs, done = cut(pairs), []
        n = max(1, -(-pairs.count() // AT_A_TIME))
        more = [c for c in pairs.columns if c not in ("a", "b")]
        for i in range(n):
            part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == i)
            ids = cut(part.select(F.col("a").alias("node")).unionByName(part.select(F.col("b").alias("node"))).distinct())
            some = small_join(texts, ids, "node", "left_semi", 2 * AT_A_TIME)
            second = part.join(some.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            both = second.join(some.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            done.append(cut(both.select("a", "b", "text_a", "text_b", *more).mapInArrow(step, schema)))
            release(spark)
        return reduce(DataFrame.unionByName, done)

    def verify(pairs: DataFrame) -> DataFrame:
        return on_texts(_near_sketches(pairs, needed, num, den), _linked(k, num, den), "a long, b long")

    def across(parted: DataFrame) -> DataFrame:
        """Pairs between components that can still link: met in buckets with few probing members or few strangers, else found in how they differ from their hub.

        Let x lack ``gone`` shingles of the hub and have ``fresh`` ones beyond it. If x and y share no
        fresh shingle they differ in all fresh ones and in at least the difference of their gone
        ones. If they share no gone one either, their distance is the sum of their distances to
        the hub; if they link, so does each with the hub, at a smaller distance, and nothing is lost.
        Two that link with the hub need no pair, so one of a pair is ``far``.
        A pair is not made again where both rows have a shared shingle (or key) shortly before.
        """
        brief = needed.select("node", "n_shingles", *_folded())
        direct = F.least("probers", "strangers") <= FEW
        lead = F.when(F.col("strangers") < F.col("probers"), F.col("stranger")).otherwise(F.col("probe"))
        few = parted.where(direct).select("key", "node", "component", "probe", "exact", lead.alias("lead"))
        # two rows that both probe a key as a whole segment meet there in any case
        shortly = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)
        few = few.withColumn("before", F.collect_list(F.when(F.col("probe") & F.col("exact"), F.col("key"))).over(shortly))
        few = cut(small_join(few, brief, "node"))
        x, y = few.where("lead").alias("x"), few.alias("y")
        bits = reduce(add, [F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))) for f in FOLDED])
        n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
        # the few that lead are on the right, which the join buffers
        met = y.join(
            x,
            (F.col("x.key") == F.col("y.key"))
            & (~F.col("y.lead") | (F.col("x.node") < F.col("y.node")))
            & (F.col("x.component") != F.col("y.component"))
            & (F.col("x.probe") | F.col("y.probe"))
            & (F.col("x.exact") | F.col("y.exact"))
            & (F.greatest(F.abs(n - m), bits.cast("long")) * (den + num) <= (n + m) * (den - num))
            & ~F.arrays_overlap("x.before", "y.before"),
        )
        met = cut(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
        release(spark, few)
        led = parted.where(~direct & (F.col("node") != F.col("hub"))).groupBy(F.col("hub").alias("a"), F.col("node").alias("b"), "component")
        led = led.agg(F.max("probe").alias("probe"))
        led = cut(small_join(led, needed.select(F.col("node").alias("b"), *_folded()), "b"))
        schema = "hub long, node long, n long, gone long, fresh long, far boolean, is_new boolean, shingle long, before array<long>"
        schema += ", component long, probe boolean, " + ", ".join(f"{f} long" for f in FOLDED)
        rows = on_texts(led, _differences(k, num, den), schema)
        x, y = rows.alias("x"), rows.alias("y")
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("hub", "is_new", "shingle")]
        most = F.floor((F.col("x.n") + F.col("y.n")) * (den - num) / (den + num))
        apart = F.abs(F.col("x.gone") - F.col("y.gone")) + F.col("x.fresh") + F.col("y.fresh")
        alike = F.greatest(F.abs(F.col("x.gone") - F.col("y.gone")), F.abs(F.col("x.fresh") - F.col("y.fresh")))
        bits = reduce(add, [F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))) for f in FOLDED])
        found = x.join(
            y,
            same[0] & same[1] & same[2]
            & ~F.arrays_overlap("x.before", "y.before")
            & (F.col("x.node") < F.col("y.node"))
            & (F.col("x.component") != F.col("y.component"))
            & (F.col("x.far") | F.col("y.far"))
            & (F.col("x.probe") | F.col("y.probe"))
            & F.when(F.col("x.is_new"), alike <= most).otherwise(apart <= most)
            & (bits <= most),
        )
        found = cut(found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
        release(spark, rows)
        return found.unionByName(led.select("a", "b")).unionByName(met)

    linked = cut(link_components(members, verify, across))
    release(spark, members, needed, texts)
    return sets, reps.join(linked, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))


def _folded() -> list[Column]:
    """The words of a folded sketch."""
    return [reduce(lambda a, b: a.bitwiseXOR(b), [F.col(p) for p in SKETCH[i :: len(FOLDED)]]).alias(f) for i, f in enumerate(FOLDED)]


def _near_sketches(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that their sizes and sketches do not rule out; no link is lost."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n_shingles", *SKETCH)]), side)
    bits = reduce(add, [F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in SKETCH])
    n, m = F.col("a_n_shingles"), F.col("b_n_shingles")
    apart = F.greatest(F.abs(n - m), bits.cast("long"))
    return pairs.where(apart * (den + num) <= (n + m) * (den - num)).select("a", "b")


def _allocated(shared: DataFrame) -> DataFrame:
    """Distinct members with their role: each set skips its longest buckets within its credit."""
    kind, spare = F.col("meta").bitwiseAND(3), F.shiftright("meta", 2).bitwiseAND((1 << 14) - 1)
    rows = shared.repartition("node").groupBy("node", "key").agg(F.min("meta").alias("meta"), F.max("length").alias("length"))
    rows = rows.withColumns({"kind": kind, "spare": spare, "band": F.shiftright("meta", 16).bitwiseAND(255)})
    cost = F.when(F.col("kind") == 1, 2).otherwise(1)
    longest_first = Window.partitionBy("node", "band").orderBy(F.desc("length"), "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("probe", F.sum(cost).over(longest_first) > F.col("spare"))
    exact = F.col("kind") < 2
    shared_here = F.sum(exact.cast("int")).over(Window.partitionBy("node"))
    return rows.select("key", "node", (F.shiftright("meta", 24) - shared_here).alias("missing"), "probe", exact.alias("exact"))


def _differences(k: int, num: int, den: int):
    """Rows ``hub, node, n, gone, fresh, far, is_new, shingle, before``: how a set differs from its hub's; other columns follow.

    A set is ``far`` if it does not link with its hub. Fresh shingles come before gone ones, each by fingerprint.
    Two sets that link differ in at most ``H`` shingles, so less than ``H + 1`` of a set's differences are not the
    other's, and the first that both have is among the first ``H + 1`` of each. Beside a far partner, whose distance to the
    hub exceeds that to the set, about half of a set's differences are the partner's too: a set that links with
    its hub needs the first half only. ``before`` holds the ``EARLIER`` next smaller ones of the same set and kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(pieces(iter([whole]), "text_a"), "text_b"):
                rows: list[list[np.ndarray]] = [[] for _ in range(11)]
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, (x, y, s, t) in enumerate(zip(a, b, shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k), strict=True)):
                    if set_key(s) != x or set_key(t) != y:
                        continue
                    gone, fresh = np.setdiff1d(s, t, assume_unique=True), np.setdiff1d(t, s, assume_unique=True)
                    apart = len(gone) + len(fresh)
                    far = apart * (den + num) > (len(s) + len(t)) * (den - num)
                    first = (len(t) + len(t) * den // num) * (den - num) // (den + num) + 1
                    if not far:
                        first = min(first, apart - (apart * (den + num) + (len(s) - len(t)) * (den - num)) // (2 * (den + num)))
                    for is_new, part, n in ((True, fresh, first), (False, gone, max(0, first - len(fresh)))):
                        part = np.sort(mix(part).view(np.int64))[:n]
                        sizes = (x, y, len(t), len(gone), len(fresh), far, is_new)
                        for column, value in zip(rows, sizes):
                            column.append(np.full(len(part), value))
                        rows[7].append(part)
                        at = np.arange(len(part))[:, None] - np.arange(1, EARLIER + 1)
                        rows[8].append(part[at[at >= 0]])
                        rows[9].append((at >= 0).sum(axis=1))
                        rows[10].append(np.full(len(part), i))
                if rows[0]:
                    kinds = [np.int64] * 5 + [bool, bool, np.int64]
                    columns = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(rows[:8], kinds, strict=True)]
                    ends = np.cumsum(np.concatenate([[0], *rows[9]])).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows[8]))))
                    names = ["hub", "node", "n", "gone", "fresh", "far", "is_new", "shingle", "before"]
                    others = batch.schema.names[4:]
                    origin = pa.array(np.concatenate(rows[10]).astype(np.int64))
                    columns += [batch.column(c).take(origin) for c in others]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, *others])

    return run


def one_per_component(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """The first row of each component of ``docs``, by (no id, id, text hash); all columns stay.

    A group without ids keeps one row. Rows with one id but different texts are separate documents; of rows
    equal in id and text one stays. Rows without a word link with nothing and all stay.
    """
    _, nodes = _nodes(docs, k, num, den)
    first = nodes.groupBy("component").agg(F.min("rep").alias("rep")).select(F.col("rep.row").alias("row__"))
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    row = F.xxhash64(F.col("text").cast("string"), F.col("doc_id").cast("long"))
    # whole copies are combined before the shuffle, which the join uses too
    one_each = docs.where(worded).withColumn("row__", row).dropDuplicates(["row__"])
    kept = one_each.join(first, "row__", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.where(~worded))
