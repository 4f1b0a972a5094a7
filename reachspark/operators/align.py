"""Bringing layers of different grids together (same coordinate system)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid


def _span(low: Column, high: Column, size: int) -> Column:
    """Integers between two real bounds, widened by one and clipped to the grid."""
    first = F.greatest(F.lit(0), (F.ceil(low) - 1).cast("int"))
    last = F.least(F.lit(size - 1), (F.floor(high) + 1).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def align_nearest(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Cells on the target grid: each takes the value of the source cell its centre lies in.

    Every source cell knows which target centres it covers, so there is no join and no shuffle.
    Other columns are carried along.
    """
    rest = [n for n in cells.columns if n not in ("r", "c")]
    left = F.lit(source.x0) + F.col("c") * F.lit(source.dx)
    top = F.lit(source.y0) - F.col("r") * F.lit(source.dy)
    cols = _span((left - target.x0) / target.dx - 0.5, (left + source.dx - target.x0) / target.dx - 0.5, target.ncols)
    rows = _span((F.lit(target.y0) - top) / target.dy - 0.5, (F.lit(target.y0) - top + source.dy) / target.dy - 0.5, target.nrows)
    moved = cells.withColumn("_c", F.explode(cols)).filter(source.col_of(target.x("_c")) == F.col("c"))
    moved = moved.withColumn("_r", F.explode(rows)).filter(source.row_of(target.y("_r")) == F.col("r"))
    return moved.select(*rest, F.col("_r").alias("r"), F.col("_c").alias("c"))


def align_bilinear(cells: DataFrame, source: Grid, target: Grid, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear values at the target centres inside the source extent.

    Each source cell contributes its weight to the target centres around it; weights are
    renormalised over the valid source cells.
    """
    px = (target.x("_c") - F.lit(source.x0)) / F.lit(source.dx) - 0.5
    py = (F.lit(source.y0) - target.y("_r")) / F.lit(source.dy) - 0.5
    mid_x, mid_y = source.x("c"), source.y("r")
    cols = _span((mid_x - source.dx - target.x0) / target.dx - 0.5, (mid_x + source.dx - target.x0) / target.dx - 0.5, target.ncols)
    rows = _span(
        (F.lit(target.y0) - mid_y - source.dy) / target.dy - 0.5, (F.lit(target.y0) - mid_y + source.dy) / target.dy - 0.5, target.nrows
    )
    spread = cells.filter(F.col(value).isNotNull()).withColumn("_c", F.explode(cols)).withColumn("_wx", 1.0 - F.abs(px - F.col("c")))
    spread = spread.filter("_wx > 0").withColumn("_r", F.explode(rows)).withColumn("_wy", 1.0 - F.abs(py - F.col("r")))
    inside = (px >= -0.5) & (px < source.ncols - 0.5) & (py >= -0.5) & (py < source.nrows - 0.5)
    spread = spread.filter("_wy > 0").filter(inside)
    w = F.col("_wx") * F.col("_wy")
    out = spread.groupBy(*keys, F.col("_r").alias("_r"), F.col("_c").alias("_c")).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))
    return out.select(*keys, F.col("_r").alias("r"), F.col("_c").alias("c"), value)


def resampled_grid(grid: Grid, factor: float) -> Grid:
    """The grid ``factor`` times coarser over the same extent."""
    nrows, ncols = max(1, int(grid.nrows / factor)), max(1, int(grid.ncols / factor))
    return Grid(nrows, ncols, grid.dx * grid.ncols / ncols, grid.dy * grid.nrows / nrows, grid.x0, grid.y0, grid.crs)


def resample(cells: DataFrame, grid: Grid, factor: float, method: str = "bilinear", value: str = "v", keys: Sequence[str] = ()) -> tuple[DataFrame, Grid]:
    """Coarser or finer cells, and their grid. ``method``: bilinear, nearest or mean (area blocks)."""
    out = resampled_grid(grid, factor)
    if method == "nearest":
        return align_nearest(cells.select(*keys, "r", "c", value), grid, out), out
    if method == "mean":
        r, c = out.row_of(grid.y("r")), out.col_of(grid.x("c"))
        return cells.groupBy(*keys, r.alias("r"), c.alias("c")).agg(F.avg(value).alias(value)), out
    if method != "bilinear":
        raise ValueError(f"unknown method {method!r}")
    return align_bilinear(cells, grid, out, value, keys), out


def align_condition(cells: DataFrame, layer_grids: dict[str, Grid], target: Grid, layer: str = "layer") -> DataFrame:
    """All layers on the target grid, with ``status`` aligned or unchanged.

    Layers sharing a source grid are moved together in one pass.
    """
    out = None
    for grid in dict.fromkeys(layer_grids.values()):
        names = [n for n, g in layer_grids.items() if g == grid]
        part = cells.filter(F.col(layer).isin(names))
        if grid.same_as(target):
            part = part.withColumn("status", F.lit("unchanged"))
        else:
            part = align_nearest(part, grid, target).withColumn("status", F.lit("aligned"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no layers to align")
    return out
