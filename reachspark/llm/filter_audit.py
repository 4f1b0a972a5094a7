"""How filters interact: what each removes, wastes and alone catches, in every order of applying them.

A document's five verdicts are one cell of a 2x2x2x2x2 table (pass or fail along each axis). Every
number the audit reports is a contraction of that table: a step's filter selects `fail` along its
axis, earlier filters select `pass`, and all others keep both. The tables have 32 cells per part,
whatever the number of documents, so all 120 orders cost one small einsum per part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.llm.textops import fingerprints, mix, pieces, spans, utf8
from reachspark.session import cut

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"

_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_FLAGS = "doc_id long, part string, same binary, bits int"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_RESULT = "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in _COUNTS)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of each text at which ``mask`` holds."""
    upto = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=upto[1:])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts of the filters that look at one text, as bits 16 (A) to 2 (D)."""
    for batch in pieces(batches, "text"):
        raw, offsets = utf8(batch.column("text"))
        starts, ends, first = spans(raw, offsets)
        n_words = np.diff(first)
        text = np.repeat(np.arange(len(n_words), dtype=np.uint64), n_words)
        _, example = np.unique(fingerprints(raw, starts, ends) + mix(text + np.uint64(1)), return_index=True)
        distinct = np.bincount(text[example].astype(np.int64), minlength=len(n_words))
        upper = _per_text((raw >= 65) & (raw <= 90), offsets)
        points = _per_text((raw & 0xC0) != 0x80, offsets)
        fails = (
            n_words < MIN_WORDS,
            100 * distinct < MIN_DISTINCT_PERCENT * n_words,
            100 * upper > MAX_UPPER_PERCENT * points,
            _per_text(_SYMBOL[raw], offsets) > 0,
        )
        bits = sum(f.astype(np.int32) << (4 - i) for i, f in enumerate(fails))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("same"), pa.array(bits, pa.int32())],
            names=["doc_id", "part", "same", "bits"],
        )


def verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id, part, same, bits``: verdicts of A to D and a 256-bit digest of the text, row by row.

    A NULL text is the empty text and a NULL source the empty part.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.withColumn("same", F.unhex(F.sha2("text", 256))).mapInArrow(_judge, _FLAGS)


def pattern_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: documents of every part by their five verdicts.

    E fails a document whose text has a smaller doc_id anywhere in the table. The smallest id of each text is
    combined before its shuffle and joined on text *and* id, so a text with many copies is no hot key.
    Rows without an id have no smaller id and no label. A document is good (toxic) if any of its labels says so.
    """
    rows = cut(verdicts(docs))
    named = rows.where("doc_id is not null")
    first = named.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    each = named.groupBy("doc_id", "part", "same", "bits").agg(F.count("*").alias("n"))
    each = each.join(first, ["same", "doc_id"], "left")
    marks = (
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    )
    each = each.join(marks, "doc_id", "left").na.fill({"good": 0, "toxic": 0})
    bits = F.col("bits") + F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1))
    known = each.groupBy("part", bits.alias("bits")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    nameless = rows.where("doc_id is null").groupBy("part", "bits").agg(F.count("*").alias("n"))
    nameless = nameless.withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    return known.unionByName(nameless).groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def selections() -> dict[str, np.ndarray]:
    """What every (order, step) selects along each axis: arrays of (600 steps, 5 axes, pass and fail)."""
    kinds: dict[str, list] = {"kept": [], "removed": [], "failed": [], "alone": []}
    for order in ORDERS:
        for i, own in enumerate(order):
            before = set(order[:i])
            kinds["kept"].append([_PASS if a in before or a == own else _ALL for a in range(5)])
            kinds["removed"].append([_FAIL if a == own else _PASS if a in before else _ALL for a in range(5)])
            kinds["failed"].append([_FAIL if a == own else _ALL for a in range(5)])
            kinds["alone"].append([_FAIL if a == own else _PASS for a in range(5)])
    return {k: np.array(v, np.int64) for k, v in kinds.items()}


def contract(tables: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every part and (order, step), from ``(parts, 3, 2, 2, 2, 2, 2)`` tables of all, good and toxic documents."""
    chosen = selections()

    def along(table: np.ndarray, kind: str) -> np.ndarray:
        return np.einsum("pabcde,xa,xb,xc,xd,xe->px", table, *chosen[kind].transpose(1, 0, 2), optimize=True)

    every, good, toxic = tables[:, 0], tables[:, 1], tables[:, 2]
    removed = along(every, "removed")
    own = np.array([a for order in ORDERS for a in order])
    by_filter = removed @ (own[:, None] == np.arange(5))
    return {
        "kept": along(every, "kept"),
        "removed": removed,
        "redundant": along(every, "failed") - removed,
        "unique_fails": along(every, "alone"),
        "good_lost": along(good, "removed"),
        "toxic_lost": along(toxic, "removed"),
        "shapley": by_filter[:, own],
    }


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = ["".join(FILTERS[a] for a in order) for order in ORDERS for _ in order]
    steps = [i + 1 for order in ORDERS for i in range(len(order))]
    for whole in batches:
        for start in range(0, whole.num_rows, 64):
            batch = whole.slice(start, 64)
            parts = batch.column("part").to_pylist()
            tables = np.zeros((len(parts), 3, 32), np.int64)
            for p, cells in enumerate(batch.column("cells").to_pylist()):
                for cell in cells:
                    tables[p, :, cell["bits"]] = cell["n"], cell["good"], cell["toxic"]
            found = contract(tables.reshape(len(parts), 3, *(2,) * 5))
            columns = [np.repeat(np.array(parts, object), len(orders)), np.tile(orders, len(parts)), np.tile(np.array(steps, np.int32), len(parts))]
            columns += [found[name].ravel() for name in _COUNTS]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "filter_order", "step", *_COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``kept`` documents are left after the step and ``removed`` go in it; ``redundant`` ones fail its filter but
    went before; ``unique_fails`` fail no other filter; ``good_lost`` and ``toxic_lost`` are the labelled ones of those
    removed; ``shapley`` sums what the step's filter removes over all orders. Repeated rows count as often as they
    occur, texts of any length are read whole, columns beyond those named are ignored, and an
    empty table has no parts and so no rows.
    """
    cells = F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells")  # 32 at most
    return pattern_counts(docs, labels).groupBy("part").agg(cells).mapInArrow(_audit, _RESULT)
