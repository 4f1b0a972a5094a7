"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is a polynomial of the turns' hashes, so all keys
of a conversation are prefix sums. Turns are range-partitioned by conversation and turn, a long
conversation over many partitions, and each partition sums up its own part; one row per conversation and partition carries
count and sum on. Rebuilding a conversation on another one's first turns shifts a polynomial, which is a
multiplication and an addition.

Subtree totals do not walk down the trie. A round rakes all leaves into their parents and
compresses unary nodes, a random third of each chain or more, into their only child; it is one aggregation and two joins. Rounds grow
with the logarithm of the number of nodes, whatever the depth. A compressed node remembers its
heir and what to add to the heir's total; these links are then doubled until they end at raked
nodes, which gives every total back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachspark.session import cut, spread

#: Every FAMILY-th conversation lends its first turns, fewer than HEADS of them.
FAMILY, HEADS = 5, 9
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = 1 << 64
_PIECE = 1 << 16

_TURNS = "conv_id long, part int, i long, s1 long, s2 long, t1 long, t2 long, n_bytes long"
_STEPS = "conv_id long, depth long, a long, b long, up_a long, up_b long, n_bytes long, last boolean"
_SHIFTS = "conv_id long, part int, from_i long, up_to_depth long, n long, k1 long, k2 long, m1 long, m2 long"


def _signed(x: int) -> int:
    x %= _WORD
    return x - _WORD if x >= _WORD // 2 else x


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and sum before each turn, inside its partition's part of the conversation."""
    part = TaskContext.get().partitionId()
    at, place, sums = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        size = np.diff(np.append(start, len(conv)))
        i = np.arange(len(conv)) - np.repeat(start, size)
        if conv[0] != at:
            place, sums = 0, [0, 0]
        before, next_sums = [], []
        for lane, base in enumerate(_BASES):
            power = np.full(len(conv), base, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)[i]
            power[: size[0]] *= np.uint64(pow(base, place, _WORD))
            term = batch.column(f"t{lane + 1}").to_numpy().view(np.uint64) * power
            total = np.cumsum(term)
            s = total - term
            s -= np.repeat(s[start], size)
            s[: size[0]] += np.uint64(sums[lane])
            before.append(s.view(np.int64))
            next_sums.append(int(s[-1] + term[-1]))
        i[: size[0]] += place
        at, place, sums = conv[-1], int(i[-1]) + 1, next_sums
        columns = [conv, np.full(len(conv), part, np.int32), i, *before, batch.column("t1"), batch.column("t2"), batch.column("n_bytes")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _TURNS.split(", ")])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns of every conversation, numbered in parts; ties of ``turn`` (NULL first) go by role and text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie")
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order, "tie").sortWithinPartitions(*order)
    rows = rows.select(
        "conv_id", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("turn"), "text", "role").alias("t2"), F.octet_length("text").cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(_number, _TURNS)


def _polynomial(turns: list[dict]) -> list[int]:
    return [sum(t[f"t{k + 1}"] * pow(b, i, _WORD) for i, t in enumerate(turns)) % _WORD for k, b in enumerate(_BASES)]


def _rebuild(row: dict) -> tuple[list[tuple], list[tuple], bool]:
    """What a conversation takes over, how its own parts move, and whether it is left without turns."""
    c, h, n = row["conv_id"], row["h"], row["n"]
    lent = (row["lent"] or [])[:h]
    b = len(lent)
    last = b + max(n - h, 0)
    keys = [_polynomial(lent[:d]) for d in range(b + 1)]
    heads = [(c, d, *map(_signed, keys[d]), *map(_signed, keys[d - 1]), lent[d - 1]["n_bytes"], d == last) for d in range(1, b + 1)]
    own = _polynomial(row["head"][:h])
    shifts = []
    offset, carried = 0, [0, 0]
    for part in sorted(row["parts"], key=lambda p: p["part"]):
        if offset + part["n"] > h:
            move = [pow(base, b - h, _WORD) for base in _BASES]
            k = [_signed(keys[b][j] + (carried[j] - own[j]) * move[j]) for j in (0, 1)]
            m = [_signed(pow(base, offset + b - h, _WORD)) for base in _BASES]
            shifts.append((c, part["part"], max(h - offset, 0), offset - h + b, n - offset, *k, *m))
        for j, base in enumerate(_BASES):
            carried[j] += part[f"s{j + 1}"] * pow(base, offset, _WORD)
        offset += part["n"]
    return heads, shifts, last == 0


def rebuilt_steps(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``steps``: one row per turn of every rebuilt conversation, with its node and the node before; and the turnless ones."""
    turns = cut(ordered_turns(conversations))
    lead = F.sort_array(F.collect_list(F.when(F.col("i") < HEADS - 1, F.struct("i", "t1", "t2", "n_bytes"))))
    whole = F.max(F.struct("i", "s1", "s2", "t1", "t2"))
    parts = turns.groupBy("conv_id", "part").agg(lead.alias("head"), whole.alias("w")).selectExpr("conv_id", "part", "head", "w.i + 1 as n", "w")
    # one row per partition that holds a piece of the conversation
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "n", "w", "head"))).alias("parts"))
    convs = convs.withColumns(
        {"head": F.slice(F.flatten(F.col("parts.head")), 1, HEADS - 1), "h": (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")}
    )
    convs = cut(convs.withColumn("parts", F.transform("parts", lambda p: F.struct(p["part"], p["n"], p["w"].alias("w")))))
    lent = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("lent"))
    rows = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(lent, "base", "left")
    kinds = f"array<struct<{_STEPS.replace(' ', ':').replace(',:', ',')}>>", f"array<struct<{_SHIFTS.replace(' ', ':').replace(',:', ',')}>>"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [[f.split()[0] for f in ddl.split(", ")] for ddl in (_STEPS, _SHIFTS)]
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                for p in row["parts"]:
                    w = p["w"]
                    for j, base in enumerate(_BASES, 1):
                        p[f"s{j}"] = w[f"s{j}"] + w[f"t{j}"] * pow(base, w["i"], _WORD)
                found.append(_rebuild(row))
            types = [pa.list_(pa.struct([(n, _ARROW[k]) for n, k in (f.split() for f in ddl.split(", "))])) for ddl in (_STEPS, _SHIFTS)]
            columns = [pa.array([[dict(zip(names[k], r, strict=True)) for r in f[k]] for f in found], types[k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns, pa.array([f[2] for f in found], pa.bool_())], names=["conv_id", "heads", "shifts", "turnless"])

    made = cut(rows.select("conv_id", "n", "h", "head", "parts", "lent").mapInArrow(rebuild, f"conv_id long, heads {kinds[0]}, shifts {kinds[1]}, turnless boolean"))
    heads = made.select(F.inline("heads"))
    moved = turns.join(made.select(F.inline("shifts")), ["conv_id", "part"]).where("i >= from_i")
    own = moved.mapInArrow(_shift, _STEPS)
    return cut(heads.unionByName(own)), made.where("turnless").select("conv_id")


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of own turns after the shift: ``k + s m`` before the turn and ``t B^i m`` more after it."""
    for batch in batches:
        col = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        keys, ups = [], []
        for lane, base in enumerate(_BASES, 1):
            s, t, k, m = (col[f"{x}{lane}"].view(np.uint64) for x in "stkm")
            high, low = np.divmod(col["i"], 1 << 16)
            power = _powers(base, 1 << 16)[low] * _powers(pow(base, 1 << 16, _WORD), int(high.max(initial=0)) + 1)[high]
            up = k + s * m
            ups.append(up.view(np.int64))
            keys.append((up + t * power * m).view(np.int64))
        depth = col["i"] + col["up_to_depth"] + 1
        columns = [col["conv_id"], depth, *keys, *ups, col["n_bytes"], col["i"] == col["n"] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in _STEPS.split(", ")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def trie_nodes(steps: DataFrame, turnless: DataFrame) -> DataFrame:
    """``node, up, conv_id, depth, n_convs, own``: distinct prefixes; ``own`` is what the node itself saves."""
    key, up = F.struct("a", "b"), F.struct(F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    nodes = steps.groupBy(key.alias("node")).agg(
        F.first(up).alias("up"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("n_bytes").alias("n_bytes")
    )
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes")
    first = steps.where("depth = 1").select("conv_id").unionByName(turnless)
    root = first.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    empty = F.lit(None).cast("struct<a:long,b:long>")
    root = root.select(
        F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("node"), empty.alias("up"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("own")
    )
    return nodes.unionByName(root)


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``node`` and the sum of each value over the node's subtree, by raking and compressing.

    ``nodes(node, up, n_children, values...)`` has a NULL ``up`` at roots and may be a forest. A node's children are
    combined before the shuffle, so one with a third of all nodes below it is no hot group.
    """
    live = cut(nodes.select("node", "up", F.col("n_children").alias("k"), *values, *[F.lit(0).cast("long").alias(f"e_{v}") for v in values]))
    raked, links, rounds = [], [], 0
    while not live.where("up is not null").isEmpty():
        rounds += 1
        leaf, inner = F.col("k") == 0, F.col("k") > 0
        # rake: leaves and what they bring, and the children that stay
        arrived = live.where("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.count(F.when(inner, 1)).alias("left"),
            F.min(F.when(inner, F.col("node"))).alias("only"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(f"e_{v}")).otherwise(0)).alias(f"r_{v}") for v in values],
        )
        raked.append(live.where(leaf & F.col("up").isNotNull()).select("node", *values))
        stay = live.where(inner).join(arrived, "node").withColumn("k", F.col("left"))
        stay = stay.withColumns({v: F.col(v) + F.col(f"r_{v}") for v in values})
        done = live.where(leaf & F.col("up").isNull()).withColumn("only", F.lit(None).cast("struct<a:long,b:long>"))
        stay = stay.select(done.columns).unionByName(done)
        # compress: unary nodes that rank above their parent and their only child
        rank = lambda x: F.xxhash64(F.lit(rounds), x)
        goes: Column = F.coalesce((F.col("k") == 1) & F.col("up").isNotNull() & (rank("node") > rank("only")) & (rank("node") > rank("up")), F.lit(False))
        stay = stay.withColumn("goes", goes)
        gone = stay.where("goes").select(
            F.col("only").alias("node"), F.col("node").alias("gone"), F.col("up").alias("to"), *[F.col(v).alias(f"g_{v}") for v in values], *[F.col(f"e_{v}").alias(f"h_{v}") for v in values]
        )
        met = stay.where("not goes").drop("goes", "only").join(gone, "node", "left")
        lost = F.col("gone").isNotNull()
        met = met.withColumn("up", F.when(lost, F.col("to")).otherwise(F.col("up"))).withColumns(
            # the gone node's own share, then what passes through it
            {f"g_{v}": F.col(f"g_{v}") + F.col(f"e_{v}") for v in values}
        )
        met = met.withColumns({f"e_{v}": F.when(lost, F.col(f"g_{v}") + F.col(f"h_{v}")).otherwise(F.col(f"e_{v}")) for v in values})
        table = cut(met.drop("to", *[f"h_{v}" for v in values]))
        links.append(table.where("gone is not null").select(F.col("gone").alias("node"), F.col("node").alias("heir"), *[F.col(f"g_{v}").alias(v) for v in values]))
        live = table.select("node", "up", "k", *values, *[f"e_{v}" for v in values])
    known = live.select("node", *values)
    for part in raked:
        known = known.unionByName(part)
    if not links:
        return known
    chain = links[0]
    for part in links[1:]:
        chain = chain.unionByName(part)
    chain = cut(chain)
    for _ in range((rounds - 1).bit_length()):
        # an heir that went in a later round hands on to its own heir
        on = chain.select(F.col("node").alias("heir"), F.col("heir").alias("next"), *[F.col(v).alias(f"n_{v}") for v in values])
        chain = chain.join(on, "heir", "left").select(
            "node", F.coalesce("next", "heir").alias("heir"), *[(F.col(v) + F.coalesce(f"n_{v}", F.lit(0))).alias(v) for v in values]
        )
        chain = cut(chain)
    known = cut(known)
    ends = known.select(F.col("node").alias("heir"), *[F.col(v).alias(f"n_{v}") for v in values])
    back = chain.join(ends, "heir").select("node", *[(F.col(v) + F.col(f"n_{v}")).alias(v) for v in values])
    return known.unionByName(back)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which come in order; a node's pieces are never held together."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for a, b, piece in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield _digests(done)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], names=["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the ids in ``ends(a, b, conv_id)``.

    Ids are put in order in pieces of at most 65 536 consecutive numbers; a node's digest, which is
    sequential by nature, then streams over its pieces in one task that keeps one piece at a time.
    """
    pieces = ends.groupBy("a", "b", F.floor(F.col("conv_id") / _PIECE).alias("block")).agg(F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("piece"))
    found = spread(pieces, "a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "piece").mapInArrow(_digest, "a long, b long, ends_sha256 string")
    return found.select(F.struct("a", "b").alias("node"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Rows without a conv_id are no conversation and left out; NULL role or text is empty; repeated rows are turns
    of their own; a table without conversations gives no rows. Columns beyond the four are ignored.
    """
    steps, turnless = rebuilt_steps(conversations)
    nodes = cut(trie_nodes(steps, turnless))
    children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    root = nodes.where("up is null").agg(F.min("conv_id")).scalar()
    # all first turns hang on the root: no join for them
    low = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, root))
    named = nodes.where("depth > 1").join(parents, "up").unionByName(low)
    named = named.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    named = cut(named.withColumn("leaf", (F.col("n_children") == 0).cast("long")))
    totals = subtree_totals(named.select("node", "up", "n_children", "leaf", "own"), ["leaf", "own"])
    ends = steps.where("last").select("a", "b", "conv_id")
    zero = F.lit(0).cast("long")
    digests = end_digests(ends.unionByName(turnless.select(zero.alias("a"), zero.alias("b"), "conv_id")))
    out = named.drop("leaf", "own").join(totals, "node").join(digests, "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), F.col("own").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
