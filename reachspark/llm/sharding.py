"""Sharding by minimax contiguous partition of groups of equal texts.

The atomic units are groups of rows with equal texts, ordered by a 64-bit key of the text. The
smallest capacity with which greedy filling needs no more than the wanted shards is found by
binary search: no contiguous partition has a smaller largest shard. It is the upper bound; below it
groups above the mean have shards of their own and the others are cut near the mean of what is left.

The driver never sees all groups. It holds cells, stretches of the key order with their total and
largest group. A greedy cut can only fall into few cells at the capacities still possible; those
alone are split further, until every cell that matters is one group; then cells that are coarse
against a mean shard. Cells are at most ``2**first_bits`` plus about ``n_shards**2 / 2 * 2**next_bits``
per level, or ``32 * n_shards * 2**next_bits`` for the coarse ones, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachspark.llm.linking import small_join
from reachspark.session import cut

FIXED_BYTES = 16


@dataclass(frozen=True)
class Cell:
    """A stretch of the key order: the keys ``lo <= key <= hi``."""

    lo: int
    hi: int
    size: int
    largest: int
    groups: int


def greedy(sizes: list[int], capacity: int) -> list[int] | None:
    """First index of each shard after the first when every shard is filled as far as it goes.

    None if one unit exceeds the capacity.
    """
    ends = list(accumulate(sizes))
    cuts, start = [], 0
    while True:
        at = bisect_right(ends, start + capacity)
        if at == len(sizes):
            return cuts
        if at == (cuts[-1] if cuts else 0):
            return None
        cuts.append(at)
        start = ends[at - 1]


def _near_means(sizes: list[int], capacity: int, n_shards: int) -> list[int]:
    """First index of each shard after the first: every shard ends nearest to the mean of what is left.

    No shard exceeds the capacity, and none takes so little that the rest would not fit the shards
    left; none is empty as long as there are units.
    """
    ends = [0, *accumulate(sizes)]
    n = len(sizes)
    # filled from the back: with k shards left, these may begin at latest[k] at the earliest
    latest = [n]
    for _ in range(n_shards):
        latest.append(bisect_left(ends, ends[latest[-1]] - capacity))
    cuts, start = [], 0
    for left in range(n_shards - 1, 0, -1):
        low = max(latest[left], start + 1)
        if low >= n:
            break
        high = min(bisect_right(ends, ends[start] + capacity) - 1, max(n - left, low))
        goal = ends[start] + (ends[n] - ends[start]) / (left + 1)
        at = bisect_left(ends, goal)
        if at > start + 1 and goal - ends[at - 1] <= ends[min(at, n)] - goal:
            at -= 1
        start = min(max(at, low), high)
        cuts.append(start)
    return cuts


def balanced(sizes: list[int], capacity: int, n_shards: int) -> list[int]:
    """Cuts within the capacity at which the shards are near equal, apart from units above the mean.

    Such units have shards of their own; the stretches between them share the other shards by size.
    """
    # units above the mean of all that is not in such units
    rest, shards, giants = sum(sizes), n_shards, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if shards < 2 or sizes[i] * shards <= rest:
            break
        giants.append(i)
        rest, shards = rest - sizes[i], shards - 1
    edges = [-1, *sorted(giants), len(sizes)]
    stretches = [(a + 1, b) for a, b in zip(edges, edges[1:]) if a + 1 < b]
    if giants and len(stretches) <= shards:
        given = [1] * len(stretches)
        sums = [sum(sizes[a:b]) for a, b in stretches]
        for _ in range(shards - len(stretches)):
            open_ = [(sums[i] / given[i], -i) for i, (a, b) in enumerate(stretches) if given[i] < b - a]
            if not open_:
                break
            given[-max(open_)[1]] += 1
        firsts = set(giants)
        for (a, b), k in zip(stretches, given, strict=True):
            part = sizes[a:b]
            if smallest_capacity(part, k) > capacity:
                break
            firsts.update([a, *(a + x for x in _near_means(part, capacity, k))])
        else:
            return sorted(firsts - {0})
    return _near_means(sizes, capacity, n_shards)


def smallest_capacity(sizes: list[int], n_shards: int) -> int:
    """The smallest capacity at which greedy filling needs at most ``n_shards`` shards."""
    if not sizes:
        return 0
    lo = max(max(sizes), -(-sum(sizes) // n_shards))
    hi = lo + max(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        cuts = greedy(sizes, mid)
        if cuts is not None and len(cuts) < n_shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _open_cells(cells: list[Cell], n_shards: int) -> tuple[int, list[int]]:
    """The capacity if cells are kept whole, and the cells in which a best cut may still fall.

    The best capacity lies between that of fluid sizes (or the largest group) and that of whole
    cells. The j-th cut is no earlier than with the former and whole cells, given that a shard
    may stop short by less than the largest group, and no later than ``j`` full shards of the latter.
    """
    sizes = [c.size for c in cells]
    upper = smallest_capacity(sizes, n_shards)
    lower = max(max(c.largest for c in cells), -(-sum(sizes) // n_shards))
    ends = list(accumulate(sizes))
    found: set[int] = set()
    early = 0
    for j in range(1, n_shards):
        # the group that does not fit any more begins in the cell of `early + lower`
        first = bisect_right(ends, early + lower)
        if first == len(cells):
            break
        early = max(ends[first - 1] if first else 0, early + lower - cells[first].largest + 1)
        last = min(bisect_right(ends, j * upper), len(cells) - 1)
        found.update(range(first, last + 1))
    return upper, [i for i in sorted(found) if cells[i].groups > 1]


def _group_key(text: Column) -> Column:
    """The key of a text; NULL texts form a group of their own, texts with one key stay together."""
    return F.xxhash64(text, text.isNull())


def _cells(groups: DataFrame, width: int, ranges: list[Cell] | None) -> list[Cell]:
    """Sums of groups over key stretches of ``2**width`` keys, inside ``ranges`` if given."""
    rows = groups
    if ranges is not None:
        spark = groups.sparkSession
        bounds = spark.createDataFrame([(c.lo, c.hi) for c in ranges], "lo long, hi long")
        # ranges are disjoint: a key belongs to the range that begins at its parent stretch
        span = (ranges[0].hi - ranges[0].lo + 1).bit_length() - 1
        rows = rows.withColumn("lo", F.shiftleft(F.shiftright("key", span), span))
        rows = rows.join(F.broadcast(bounds), "lo", "left_semi")
    found = (
        rows.groupBy(F.shiftright("key", width).alias("cell"))
        .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups"))
        .collect()
    )
    return sorted(
        (Cell(r["cell"] << width, ((r["cell"] + 1) << width) - 1, r["size"], r["largest"], r["groups"]) for r in found),
        key=lambda c: c.lo,
    )


def _split(groups: DataFrame, cells: list[Cell], chosen: list[int], next_bits: int) -> list[Cell]:
    """The cells with the chosen ones replaced by finer cells."""
    by_span: dict[int, list[Cell]] = {}
    for i in chosen:
        by_span.setdefault(cells[i].hi - cells[i].lo, []).append(cells[i])
    gone = set(chosen)
    kept = [c for i, c in enumerate(cells) if i not in gone]
    for span, ranges in by_span.items():
        finer = max(0, (span + 1).bit_length() - 1 - next_bits)
        kept += _cells(groups, finer, ranges)
    return sorted(kept, key=lambda c: c.lo)


def _plan(groups: DataFrame, n_shards: int, first_bits: int, next_bits: int) -> tuple[int, list[Cell]]:
    """The smallest capacity and cells that are fine enough to know it."""
    cells = _cells(groups, 64 - first_bits, None)
    if not cells:
        return 0, []
    while True:
        capacity, uncertain = _open_cells(cells, n_shards)
        if not uncertain:
            return capacity, cells
        cells = _split(groups, cells, uncertain, next_bits)


def plan_cuts(groups: DataFrame, n_shards: int, first_bits: int = 14, next_bits: int = 5) -> tuple[int, list[int]]:
    """The smallest capacity and the first key of every shard after the first when shards are filled up to it.

    ``groups(key, size)`` has one row per atomic unit; units with one key stay together.
    """
    capacity, cells = _plan(groups, n_shards, first_bits, next_bits)
    if not cells:
        return 0, []
    cuts = greedy([c.size for c in cells], capacity)
    return capacity, [cells[i].lo for i in cuts]


def plan_balanced_cuts(groups: DataFrame, n_shards: int, first_bits: int = 14, next_bits: int = 5) -> tuple[int, list[int]]:
    """The smallest capacity and the first key of every shard after the first, with near equal shards below it.

    Cells hold, next to their largest group, no more than a 32nd of a mean shard, or are one group.
    """
    capacity, cells = _plan(groups, n_shards, first_bits, next_bits)
    fine = sum(c.size for c in cells) / (32 * n_shards)
    while coarse := [i for i, c in enumerate(cells) if c.groups > 1 and c.size - c.largest > fine]:
        cells = _split(groups, cells, coarse, next_bits)
    return capacity, [cells[i].lo for i in balanced([c.size for c in cells], capacity, n_shards)]


def shard_documents(docs: DataFrame, n_shards: int, text: str = "text", first_bits: int = 14, next_bits: int = 5) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``shard`` and ``slot``; shards have near equal bytes.

    ``size`` is the UTF-8 length of the text (NULL: 0) plus 16. Rows with equal texts share a
    shard; NULL texts are one group, as are empty ones. The largest shard is as small as any
    contiguous partition of the groups allows, at most the mean plus the largest group; groups above
    the mean do not unbalance the other shards. ``slot`` counts a shard's rows from 0 without gaps, repeated rows included. Input columns named like
    the three new ones are replaced. An empty table gives no rows. Hot texts are combined before
    the shuffle; rows themselves are not shuffled at all: they are written once, sorted by shard
    within each file, and slots come from file positions and a table of counts, one row per file and shard,
    which is broadcast if it is counted to be small. The cuts balance shards below the minimax capacity, which
    stays a bound; :func:`plan_cuts` gives the greedy filling to it.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    key = _group_key(F.col(text))
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(FIXED_BYTES)).cast("long")
    rows = docs.drop("size", "shard", "slot").withColumn("size", size)
    groups = cut(rows.groupBy(key.alias("key")).agg(F.sum("size").alias("size")))
    _, firsts = plan_balanced_cuts(groups, n_shards, first_bits, next_bits)
    shard = sum((F.when(key >= F.lit(k), 1).otherwise(0) for k in firsts), F.lit(0)).cast("int")
    placed = cut(rows.withColumn("shard", shard).sortWithinPartitions("shard"))
    return _slots(placed)


def _slots(placed: DataFrame) -> DataFrame:
    """Number the rows of every shard over files that are sorted by shard."""
    row = placed.select("*", F.col("_metadata.file_name").alias("file__"), F.col("_metadata.row_index").alias("row__"))
    runs = row.groupBy("shard", "file__").agg(F.min("row__").alias("first__"), F.count("*").alias("n__"))
    earlier = Window.partitionBy("shard").orderBy("file__").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n__").over(earlier), F.lit(0)) - F.col("first__")
    runs = runs.select("shard", "file__", base.alias("shift__"))
    joined = small_join(row, cut(runs), ["shard", "file__"])
    return joined.select(*[c for c in placed.columns], (F.col("row__") + F.col("shift__")).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the rows of :func:`shard_documents` to one folder per shard."""
    placed.write.partitionBy("shard").parquet(path)
