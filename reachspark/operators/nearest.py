"""Exact nearest source cell by a separable distance transform.

Pass 1 works on strips of bounded height and width and finds, for every row, the nearest source of
that column; the last source before a strip and the first one after it come from a window over
one row per column and strip. Pass 2 works on blocks of rows and finds the best column. The best column moves monotonically
with the target column, so rows are solved by divide and conquer in n log n, all rows of a block at once. Groups are
bounded by ``block_cells`` and, in pass 2, by one row of the grid, whatever its height.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..session import spread


def nearest_source(targets: DataFrame, sources: DataFrame, grid: Grid, value: str = "v", keys: Sequence[str] = (), block_cells: int = 65536) -> DataFrame:
    """Distance, position and value of the source nearest to every target cell.

    Ties go to the smallest (row, column). Returns ``keys, r, c, src_r, src_c, dist, v``;
    targets of a key without any source are absent.
    """
    keys = list(keys)
    nrows, ncols = grid.nrows, grid.ncols
    width = max(1, min(ncols, 64))
    strip = max(1, block_cells // width)
    rows_per_block = max(1, min(nrows, block_cells // max(ncols, 1)))
    dx, dy = abs(grid.dx), abs(grid.dy)

    src = sources.select(
        *keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(value).cast("double").alias("v")
    )
    schemas = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    key_ddl = "".join(f"{k} {schemas[k]}, " for k in keys)

    def by_column(key, pdf):
        first_row = int(key[-1]) * strip
        rows = np.arange(first_row, min(first_row + strip, nrows))
        sr, sc, sv = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), pdf["v"].to_numpy()
        by = np.lexsort((sr, sc))
        sr, sc, sv = sr[by], sc[by], sv[by]
        # all columns at once: a source's place is its column's number, then its row
        cols, start, which, count = np.unique(sc, return_index=True, return_inverse=True, return_counts=True)
        after = np.searchsorted(which * nrows + sr, np.arange(len(cols))[:, None] * nrows + rows)
        above = np.maximum(after - 1, start[:, None])
        below = np.minimum(after, (start + count - 1)[:, None])
        pick = np.where(np.abs(rows - sr[above]) <= np.abs(sr[below] - rows), above, below).ravel()
        out = pd.DataFrame({"r": np.tile(rows, len(cols)), "c": np.repeat(cols, len(rows)), "src_r": sr[pick], "v": sv[pick]})
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out.astype({"r": "int32", "c": "int32", "src_r": "int32"})

    # what a strip needs from the others: per column the last source before it and the first after
    placed = src.withColumn("_s", F.floor(F.col("r") / strip))
    here = F.struct("r", "v")
    ends = placed.groupBy(*keys, "c", "_s").agg(F.min(here).alias("_first"), F.max(here).alias("_last"))
    strips = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((nrows - 1) // strip).cast("long")))
    every = src.select(*keys, "c").distinct().withColumn("_s", strips).join(ends, [*keys, "c", "_s"], "left")
    along = Window.partitionBy(*keys, "c").orderBy("_s")
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    beyond = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    carried = every.withColumns({"_p": before, "_n": beyond})
    carried = carried.select(*keys, "c", "_s", F.explode(F.array_compact(F.array("_p", "_n"))).alias("_e"))
    carried = carried.select(*keys, F.col("_e.r").alias("r"), "c", F.col("_e.v").alias("v"), "_s")
    pieces = placed.unionByName(carried).withColumn("_b", F.floor(F.col("c") / width))
    columns = (
        spread(pieces, *keys, "_b", "_s").groupBy(*keys, "_b", "_s").applyInPandas(by_column, f"{key_ddl}r int, c int, src_r int, v double")
    )

    def by_row(key, left, right):
        have = right.sort_values(["r", "c"])
        row, sc, sr = (have[n].to_numpy(np.int64) for n in ("r", "c", "src_r"))
        place = np.unique(left["r"].to_numpy(np.int64) * ncols + left["c"].to_numpy(np.int64))
        place = place[np.isin(place // ncols, row)]
        tr, tc = np.divmod(place, ncols)
        # all rows of the block at once, each a range of targets and one of sources
        rows, lo, size = np.unique(tr, return_index=True, return_counts=True)
        ranges = lo, lo + size, np.searchsorted(row, rows), np.searchsorted(row, rows, "right") - 1
        best, d2 = _best_columns(tc, sc, ((sr - row) * dy) ** 2, sr * ncols + sc, dx, ranges)
        out = pd.DataFrame({"r": tr, "c": tc, "src_r": sr[best], "src_c": sc[best], "dist": np.sqrt(d2), "v": have["v"].to_numpy()[best]})
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out.astype({"r": "int32", "c": "int32", "src_r": "int32", "src_c": "int32"})

    block = F.floor(F.col("r") / rows_per_block)
    want = targets.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    return (
        spread(want.withColumn("_b", block), *keys, "_b")
        .groupBy(*keys, "_b")
        .cogroup(spread(columns.withColumn("_b", block), *keys, "_b").groupBy(*keys, "_b"))
        .applyInPandas(by_row, f"{key_ddl}r int, c int, src_r int, src_c int, dist double, v double")
    )


def _best_columns(tc, sc, g2, rank, dx, ranges):
    """Per target the index of the best source of its row, and the squared distance.

    The pair (squared distance, rank) is minimised in that order. ``ranges`` has, for each row, the first and
    the end of its targets, the first and the last of its sources; both are in order of their columns.
    """
    best = np.zeros(len(tc), dtype=np.int64)
    dist = np.zeros(len(tc))
    lo, hi, a, b = ranges
    while len(lo):
        mid = (lo + hi) // 2
        size = b - a + 1
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        idx = np.arange(size.sum()) + np.repeat(a - start, size)
        cost = (dx * (np.repeat(tc[mid], size) - sc[idx])) ** 2 + g2[idx]
        low = np.minimum.reduceat(cost, start)
        order = np.where(cost == np.repeat(low, size), rank[idx], np.iinfo(np.int64).max)
        first = np.minimum.reduceat(order, start)
        pick = idx[order == np.repeat(first, size)]
        best[mid], dist[mid] = pick, low
        lo, hi, a, b = (
            np.concatenate((lo, mid + 1)),
            np.concatenate((mid, hi)),
            np.concatenate((a, pick)),
            np.concatenate((pick, b)),
        )
        keep = lo < hi
        lo, hi, a, b = lo[keep], hi[keep], a[keep], b[keep]
    return best, dist
