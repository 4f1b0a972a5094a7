"""Polygons to cells and cells to polygons.

Polygons are vertex tables ``poly_id, ring, seq, x, y``: rings are closed (first vertex
repeated at the end) and ``seq`` counts 0, 1, 2, ... within a ring.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..session import cut, deal, spread
from .align import _span
from .regions import region_measures
from .stencil import grid_cells, neighbours


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Segments ``x1, y1, x2, y2`` between consecutive vertices of a ring."""
    after = vertices.select("poly_id", "ring", (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    here = vertices.select("poly_id", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    return here.join(after, ["poly_id", "ring", "seq"])


def polygon_cells(vertices: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """``poly_id, r, c`` of the cells whose centre lies inside (even-odd rule, half-open sides).

    Scanlines: every edge is cut at the row centres it spans, crossings of a row are paired,
    and each pair is a run of cells. No cell is ever tested against a polygon.
    """
    cells = _covered(vertices, grid, all_touched)
    return cells.distinct() if all_touched else cells


def _covered(vertices: DataFrame, grid: Grid, all_touched: bool) -> DataFrame:
    """Rows of ``polygon_cells``; cells touched by several sides come several times."""
    # a few edges become many cells: dealt out before they do
    edges = deal(polygon_edges(vertices), "poly_id")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = _span((F.lit(grid.y0) - high) / grid.dy - 0.5, (F.lit(grid.y0) - low) / grid.dy - 0.5, grid.nrows)
    cuts = edges.withColumn("r", F.explode(rows)).withColumn("_y", grid.y("r")).filter((F.col("_y") >= low) & (F.col("_y") < high))
    cuts = cuts.select("poly_id", "r", (F.col("x1") + (F.col("_y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    w = Window.partitionBy("poly_id", "r").orderBy("x")
    runs = cuts.withColumn("_k", F.row_number().over(w)).withColumn("_end", F.lead("x").over(w)).filter("_k % 2 = 1")
    cols = _span((F.col("x") - grid.x0) / grid.dx - 0.5, (F.col("_end") - grid.x0) / grid.dx - 0.5, grid.ncols)
    inside = runs.withColumn("c", F.explode(cols)).filter((grid.x("c") >= F.col("x")) & (grid.x("c") < F.col("_end")))
    inside = inside.select("poly_id", "r", "c")
    if not all_touched:
        return inside
    first = F.greatest(F.lit(0), grid.row_of(high))
    last = F.least(F.lit(grid.nrows - 1), grid.row_of(low))
    band = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    pieces = edges.withColumn("r", F.explode(band))
    top, bottom = F.lit(grid.y0) - F.col("r") * grid.dy, F.lit(grid.y0) - (F.col("r") + 1) * grid.dy
    flat = F.col("y1") == F.col("y2")
    at = lambda y: F.when(flat, F.col("x1")).otherwise(
        F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(flat, F.lit(1.0)).otherwise(F.col("y2") - F.col("y1"))
    )
    xa, xb = at(F.least(top, high)), F.when(flat, F.col("x2")).otherwise(at(F.greatest(bottom, low)))
    c1 = F.greatest(F.lit(0), grid.col_of(F.least(xa, xb)))
    c2 = F.least(F.lit(grid.ncols - 1), grid.col_of(F.greatest(xa, xb)))
    along = F.when(c1 <= c2, F.sequence(c1, c2)).otherwise(F.array().cast("array<int>"))
    touched = pieces.select("poly_id", "r", F.explode(along).alias("c"))
    return inside.unionByName(touched)


def rasterize(vertices: DataFrame, attributes: DataFrame, grid: Grid, column: str = "gridcode", order: str = "seq", all_touched: bool = False, fill: float | None = None) -> DataFrame:
    """``r, c, v`` burned from polygons; the polygon with the highest ``order`` wins a cell.

    Cells outside every polygon are absent, or hold ``fill`` if one is given.
    """
    # repeated cells do not change a maximum
    cells = _covered(vertices, grid, all_touched).join(attributes.select("poly_id", column, order), "poly_id")
    burned = deal(cells, "r", "c").groupBy("r", "c").agg(F.max_by(column, order).alias("v"))
    if fill is None:
        return burned
    return grid_cells(vertices, grid).join(burned, ["r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def extract_by_mask(cells: DataFrame, vertices: DataFrame, grid: Grid, crop: bool = True) -> DataFrame:
    """Cells inside any polygon. ``crop`` adds ``row0, col0``, the origin of the clipped grid."""
    inside = cells.join(polygon_cells(vertices, grid).select("r", "c").distinct(), ["r", "c"], "left_semi")
    if not crop:
        return inside
    x, y = F.col("x"), F.col("y")
    box = vertices.agg(F.max(y).alias("top"), F.min(x).alias("left"))
    row0 = F.greatest(F.lit(0), F.floor((F.lit(grid.y0) - F.col("top")) / grid.dy)).cast("int").alias("row0")
    col0 = F.greatest(F.lit(0), F.floor((F.col("left") - F.lit(grid.x0)) / grid.dx)).cast("int").alias("col0")
    return inside.select("*", box.select(row0).scalar().alias("row0"), box.select(col0).scalar().alias("col0"))


def boundary_sides(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cell sides that separate a region from anything else, directed clockwise.

    ``r1, c1, r2, c2`` are grid corners, ``side`` is 0 top, 1 right, 2 bottom, 3 left; a side
    lies between a cell and a neighbour that is absent or of another region.
    """
    around = neighbours(labelled.select(*keys, "r", "c", "label"), "label", keys)
    beyond = ("_up", "_right", "_down", "_left")
    turns = ((0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0))
    sides = F.array(
        *[
            F.when(
                ~F.col(there).eqNullSafe(F.col("label")),
                F.struct(
                    F.lit(i).alias("side"), (F.col("r") + a).alias("r1"), (F.col("c") + b).alias("c1"), (F.col("r") + d).alias("r2"), (F.col("c") + e).alias("c2")
                ),
            )
            for i, (there, (a, b, d, e)) in enumerate(zip(beyond, turns))
        ]
    )
    return around.select(*keys, "label", F.explode(F.array_compact(sides)).alias("s")).select(*keys, "label", "s.*")


def polygonize(cells: DataFrame, grid: Grid, value: str = "v", connectivity: int = 4, keys: Sequence[str] = (), labelled: DataFrame | None = None) -> DataFrame:
    """One row per region of equal integer value: ``label, gridcode, cells, area, perimeter``.

    Values are truncated to integers first. A table of labels, if one is given, is measured as it is.
    """
    if labelled is None:
        coded = cells.filter(F.col(value).isNotNull()).withColumn("gridcode", F.col(value).cast("int"))
        measured = region_measures(coded.select(*keys, "r", "c", "gridcode"), grid, connectivity, "gridcode", keys)
        rim = F.col("flat") * F.lit(abs(grid.dx)) + F.col("steep") * F.lit(abs(grid.dy))
        return measured.select(
            *keys, "label", F.col("gridcode").cast("int").alias("gridcode"), (F.col("cells") * F.lit(grid.cell_area)).alias("area"), "cells", rim.cast("double").alias("perimeter")
        )
    sizes = labelled.groupBy(*keys, "label").agg(
        F.first("gridcode").cast("int").alias("gridcode"), (F.count(F.lit(1)) * F.lit(grid.cell_area)).alias("area"), F.count(F.lit(1)).alias("cells")
    )
    length = F.when(F.col("side") % 2 == 0, F.lit(abs(grid.dx))).otherwise(F.lit(abs(grid.dy)))
    rims = boundary_sides(labelled, keys).groupBy(*keys, "label").agg(F.sum(length).alias("perimeter"))
    return sizes.join(rims, [*keys, "label"])


def outlines(labelled: DataFrame, grid: Grid, connectivity: int = 4, one_task_sides: int = 500_000) -> DataFrame:
    """Closed rings of every region: ``label, ring, seq, x, y``, corners only.

    Regions whose outline has at most ``one_task_sides`` sides are hashed into buckets of about
    that many sides, each traced in one task; longer outlines are ordered by pointer doubling
    over joins, without ever gathering a region.
    """
    sides = cut(boundary_sides(labelled))
    counts = sides.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    long = counts.filter(F.col("_n") > one_task_sides).select("label")
    buckets = max(1, -(-sides.count() // min(one_task_sides, 20_000)))
    shape = "label bigint, ring bigint, seq bigint, r int, c int"

    def trace(pdf):
        return _trace(pdf, connectivity, grid.ncols)

    short = sides.join(long, "label", "left_anti").withColumn("_b", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    rings = spread(short, "_b").groupBy("_b").applyInPandas(lambda p: trace(p), shape)
    if not long.isEmpty():
        rings = rings.unionByName(_trace_by_joins(sides.join(long, "label", "left_semi"), connectivity, grid.ncols))
    x = F.lit(grid.x0) + F.col("c") * F.lit(grid.dx)
    y = F.lit(grid.y0) - F.col("r") * F.lit(grid.dy)
    return rings.select("label", "ring", "seq", x.alias("x"), y.alias("y"))


def _side_id(r1, c1, side, ncols):
    return (r1 * (ncols + 1) + c1) * 4 + side


def _trace(pdf: pd.DataFrame, connectivity: int, ncols: int) -> pd.DataFrame:
    """Order the sides of some regions into rings and drop the straight vertices."""
    r1, c1, r2, c2, side, lab = (pdf[n].to_numpy(np.int64) for n in ("r1", "c1", "r2", "c2", "side", "label"))
    sid = _side_id(r1, c1, side, ncols)
    by = np.argsort(sid)
    r1, c1, r2, c2, side, lab, sid = (a[by] for a in (r1, c1, r2, c2, side, lab, sid))
    n = len(sid)
    nxt = np.full(n, -1)
    for turn in (1, 0, 3) if connectivity == 4 else (3, 0, 1):
        want = _side_id(r2, c2, (side + turn) % 4, ncols)
        pos = np.clip(np.searchsorted(sid, want), 0, n - 1)
        nxt = np.where((nxt < 0) & (sid[pos] == want) & (lab[pos] == lab), pos, nxt)
    ring, jump, span = np.arange(n), nxt.copy(), 1
    while span < n:
        ring = np.minimum(ring, ring[jump])
        jump = jump[jump]
        span *= 2
    ring = np.minimum(ring, ring[jump])
    # Cut every ring before its first side, then count the sides left to the end.
    end = nxt == ring
    jump = np.where(end, np.arange(n), nxt)
    left = np.where(end, 0, 1)
    span = 1
    while span < n:
        left = left + left[jump]
        jump = jump[jump]
        span *= 2
    size = np.bincount(ring, minlength=n)
    seq = size[ring] - 1 - left
    before = np.empty(n, dtype=np.int64)
    before[nxt] = side
    out = pd.DataFrame({"label": lab, "ring": sid[ring], "seq": seq, "r": r1, "c": c1})[before != side]
    out = out.sort_values(["ring", "seq"])
    out["seq"] = out.groupby("ring").cumcount()
    close = out[out["seq"] == 0].assign(seq=out.groupby("ring").size().to_numpy())
    return pd.concat([out, close], ignore_index=True).astype({"r": "int32", "c": "int32"})


def _trace_by_joins(sides: DataFrame, connectivity: int, ncols: int) -> DataFrame:
    """The same ordering as ``_trace`` by pointer doubling on a side table."""
    sid = lambda r, c, s: (r.cast("bigint") * (ncols + 1) + c) * 4 + s
    col = F.col
    base = sides.select("label", sid(col("r1"), col("c1"), col("side")).alias("id"), "r1", "c1", "r2", "c2", "side")
    turns = (1, 0, 3) if connectivity == 4 else (3, 0, 1)
    options = F.array(*[F.struct(F.lit(i).alias("p"), sid(col("r2"), col("c2"), (col("side") + t) % 4).alias("to")) for i, t in enumerate(turns)])
    tries = base.select("label", "id", "side", F.explode(options).alias("o")).select("label", "id", "side", "o.p", "o.to")
    known = base.select("label", col("id").alias("to"))
    link = cut(tries.join(known, ["label", "to"]).groupBy("label", "id", "side").agg(F.min_by("to", "p").alias("next")))
    total = link.groupBy("label").count().agg(F.max("count")).first()[0]
    state = link.select("label", "id", col("next").alias("jump"), F.least("id", "next").alias("ring"))
    span = 1
    while span < total:
        ahead = state.select("label", col("id").alias("jump"), col("jump").alias("_j"), col("ring").alias("_r"))
        state = cut(state.join(ahead, ["label", "jump"]).select("label", "id", col("_j").alias("jump"), F.least("ring", "_r").alias("ring")))
        span *= 2
    ring = state.select("label", "id", "ring")
    rank = link.join(ring, ["label", "id"]).withColumn("end", col("next") == col("ring"))
    rank = cut(
        rank.select(
            "label", "id", "side", "next", "ring", F.when(col("end"), col("id")).otherwise(col("next")).alias("jump"), F.when(col("end"), 0).otherwise(1).cast("bigint").alias("left")
        )
    )
    span = 1
    while span < total:
        ahead = rank.select("label", col("id").alias("jump"), col("jump").alias("_j"), col("left").alias("_l"))
        rank = cut(
            rank.join(ahead, ["label", "jump"]).select("label", "id", "side", "next", "ring", col("_j").alias("jump"), (col("left") + col("_l")).alias("left"))
        )
        span *= 2
    before = rank.select("label", col("next").alias("id"), col("side").alias("_before"))
    kept = rank.join(before, ["label", "id"]).filter("side <> _before")
    kept = kept.join(base.select("label", "id", "r1", "c1"), ["label", "id"])
    w = Window.partitionBy("label", "ring").orderBy(F.desc("left"))
    out = kept.select("label", "ring", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), col("r1").cast("int").alias("r"), col("c1").cast("int").alias("c"))
    out = cut(out)
    size = out.groupBy("label", "ring").agg((F.max("seq") + 1).alias("_n"))
    close = out.filter("seq = 0").join(size, ["label", "ring"]).select("label", "ring", col("_n").alias("seq"), "r", "c")
    return out.unionByName(close)
