"""Neighbourhood operators.

The four neighbours of a cell come from tiles with a rim of one cell. Squares and discs of any
size are swept: along a row, then along a column, each target has one owner, its nearest source, and
sums up to either end of a window are running sums. The cost does not depend on the window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..session import deal, spread


def neighbours(cells: DataFrame, value: str = "v", keys: Sequence[str] = (), tile: int = 64) -> DataFrame:
    """Add ``_up, _down, _left, _right``: the value of each of the four neighbours, NULL if absent.

    Every cell goes to its tile once, cells on a tile's rim also to the tile beyond (3 % of all at
    128 cells, 6 % at 64). Inside a tile two sorts bring row and column neighbours next to each other, so
    one shuffle of about the table's size serves both directions.
    """
    tr, tc = F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)
    row, column = F.pmod(F.col("r"), F.lit(tile)), F.pmod(F.col("c"), F.lit(tile))

    def place(dr: int, dc: int) -> Column:
        return F.struct((tr + dr).alias("tr"), (tc + dc).alias("tc"), F.lit(dr == 0 and dc == 0).alias("own"))

    last = tile - 1
    places = F.array(
        place(0, 0), F.when(row == 0, place(-1, 0)), F.when(row == last, place(1, 0)), F.when(column == 0, place(0, -1)), F.when(column == last, place(0, 1))
    )
    rows = cells.withColumn("_p", F.explode(F.array_compact(places)))
    rows = rows.withColumns({"_tr": F.col("_p.tr"), "_tc": F.col("_p.tc"), "_own": F.col("_p.own")}).drop("_p")
    inside = Window.partitionBy(*keys, "_tr", "_tc")

    def beside(line: str, along: str, step: int) -> Column:
        order = inside.orderBy(line, along)
        met = (F.lag(line, step).over(order) == F.col(line)) & (F.lag(along, step).over(order) == F.col(along) - step)
        return F.when(met, F.lag(value, step).over(order))

    rows = rows.withColumns({"_left": beside("r", "c", 1), "_right": beside("r", "c", -1)})
    rows = rows.withColumns({"_up": beside("c", "r", 1), "_down": beside("c", "r", -1)})
    return rows.filter("_own").drop("_tr", "_tc", "_own")


def gradients(dem: DataFrame, grid: Grid, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``gx, gy``: central differences inside, one-sided at the grid edge.

    A gap inside the grid counts as the layer's mean, as if it had been filled beforehand.
    ``gy`` points down the rows.
    """
    dem = dem.filter(F.col(value).isNotNull())
    around = neighbours(dem.select(*keys, "r", "c", value), value, keys)
    mean = dem.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    around = around.join(mean, list(keys)) if keys else around.withColumn("_mean", mean.scalar())
    v, fill = F.col(value), F.col("_mean")

    def slope_along(before: str, after: str, index: str, size: int, step: float) -> Column:
        if size < 2:
            return F.lit(0.0)
        low, high = F.coalesce(F.col(before), fill), F.coalesce(F.col(after), fill)
        step = abs(step)
        return (
            F.when(F.col(index) == 0, (high - v) / F.lit(step))
            .when(F.col(index) == size - 1, (v - low) / F.lit(step))
            .otherwise((high - low) / F.lit(2.0 * step))
        )

    return around.select(
        *keys,
        "r",
        "c",
        value,
        slope_along("_left", "_right", "c", grid.ncols, grid.dx).alias("gx"),
        slope_along("_up", "_down", "r", grid.nrows, grid.dy).alias("gy"),
    )


def slope(dem: DataFrame, grid: Grid, units: str = "DEGREE", value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Surface slope in degrees, or percent rise."""
    rise = F.hypot("gx", "gy")
    out = rise * 100.0 if units.upper() == "PERCENT" else F.degrees(F.atan(rise))
    return gradients(dem, grid, value, keys).select(*keys, "r", "c", out.alias("slope"))


def hillshade(dem: DataFrame, grid: Grid, azimuth: float = 315.0, altitude: float = 45.0, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Relief shading from 0 to 255 for a light at ``azimuth`` and ``altitude`` degrees."""
    zenith = math.radians(90.0 - altitude)
    light = math.radians(450.0 - azimuth)
    steep = F.atan(F.hypot("gx", "gy"))
    aspect = F.atan2(-F.col("gx"), F.col("gy"))
    shade = F.lit(math.cos(zenith)) * F.cos(steep) + F.lit(math.sin(zenith)) * F.sin(steep) * F.cos(F.lit(light) - aspect)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), shade)) * 255.0
    return gradients(dem, grid, value, keys).select(*keys, "r", "c", clipped.alias("shade"))


def within_reach(rows: DataFrame, across: str, along: str, reach: int | Column, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``_at``: the places within ``reach`` of a row along its line, each listed once, at the nearest row.

    ``rows`` are distinct places; ties between two rows go to the one with the smaller ``along``.
    """
    line = Window.partitionBy(*keys, across).orderBy(along)
    here, before, after = F.col(along), F.lag(along).over(line), F.lead(along).over(line)
    first = F.greatest(here - reach, F.lit(0), F.floor((before + here) / 2) + 1)
    last = F.least(here + reach, F.lit(size - 1), F.floor((here + after) / 2))
    return rows.withColumns({"_first": first.cast("int"), "_last": last.cast("int")}).withColumn("_at", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")


def focal_fraction(cells: DataFrame, grid: Grid, window: int = 1, present: str = "present", keys: Sequence[str] = ()) -> DataFrame:
    """Share of present cells among the valid cells of each (2w+1)-square neighbourhood.

    ``cells`` lists the valid cells, each once, with a boolean ``present``. Every grid cell with at least
    one valid neighbour is returned. The box sum is separable, rows first, then columns; each is the
    difference of two running sums, whatever the window.
    """
    flags = cells.select(
        *keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.coalesce(F.col(present), F.lit(False)).cast("long").alias("p"), F.lit(1).cast("long").alias("n")
    )
    if window < 1:
        return flags.select(*keys, "r", "c", F.col("p").cast("double").alias("fraction"))
    for across, along, size in (("r", "c", grid.ncols), ("c", "r", grid.nrows)):
        rows = within_reach(deal(flags, *keys, across), across, along, window, size, keys)
        own = F.col("_at") == F.col(along)
        rows = rows.select(*keys, across, F.col("_at").alias(along), *[F.when(own, F.col(x)).otherwise(0).alias(x) for x in ("p", "n")])
        line = Window.partitionBy(*keys, across).orderBy(along)
        ahead, behind = line.rangeBetween(Window.unboundedPreceding, window), line.rangeBetween(Window.unboundedPreceding, -window - 1)
        flags = rows.withColumns({x: F.sum(x).over(ahead) - F.coalesce(F.sum(x).over(behind), F.lit(0)) for x in ("p", "n")})
    return flags.select(*keys, "r", "c", (F.col("p") / F.col("n")).alias("fraction"))


def half_widths(radius: float, grid: Grid) -> list[int]:
    """Cells to either side of the centre that a disc holds, in the rows at distance 0, 1, ... of its centre."""
    if radius <= 0:
        return [0]
    dx, dy = abs(grid.dx), abs(grid.dy)
    out = []
    for i in range(min(int(radius // dy) + 1, grid.nrows - 1) + 1):
        if math.sqrt((i * dy) ** 2) > radius:
            break
        j = int(math.sqrt(max(radius**2 - (i * dy) ** 2, 0.0)) // dx) + 1
        while math.sqrt((j * dx) ** 2 + (i * dy) ** 2) > radius:
            j -= 1
        out.append(j)
    return out


def within_radius(sources: DataFrame, grid: Grid, radius: float | Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Grid cells whose centre lies within ``radius`` of a source cell.

    A mapping gives a radius to each value of the last key, so that all kinds share one pass.

    Along each column the cells within the radius know their nearest source. Its distance says how
    wide the disc is in that row; a sweep along the row joins these intervals, so each cell is
    made once.
    """
    sources = sources.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct()
    if isinstance(radius, Mapping):
        sources = sources.filter(F.col(keys[-1]).isin(list(radius)))
        wide = {kind: half_widths(x, grid) for kind, x in radius.items()}
        pick = lambda made: F.coalesce(*[F.when(F.col(keys[-1]) == kind, F.lit(made(w))) for kind, w in wide.items()])
        reach, table = pick(lambda w: len(w) - 1), pick(list)
    else:
        table = half_widths(radius, grid)
        reach, table = F.lit(len(table) - 1), F.lit(table)
    band = within_reach(deal(sources, *keys, "c"), "c", "r", reach, grid.nrows, keys)
    width = F.element_at(table, F.abs(F.col("_at") - F.col("r")) + 1)
    first, last = F.greatest(F.col("c") - width, F.lit(0)), F.least(F.col("c") + width, F.lit(grid.ncols - 1))
    band = deal(band.select(*keys, F.col("_at").alias("r"), first.alias("_first"), last.alias("_last")), *keys, "r")
    sweep = Window.partitionBy(*keys, "r").orderBy("_first", "_last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = band.withColumn("_first", F.greatest("_first", F.max("_last").over(sweep) + 1)).filter("_first <= _last")
    return fresh.select(*keys, "r", F.explode(F.sequence("_first", "_last")).alias("c"))


def grid_cells(like: DataFrame, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """Every cell of the grid (for every key combination of ``like``), generated in parallel."""
    spark = like.sparkSession
    if not keys:
        cells = spark.range(grid.nrows * grid.ncols)
        return cells.select(
            F.floor(F.col("id") / grid.ncols).cast("int").alias("r"), (F.col("id") % grid.ncols).cast("int").alias("c")
        )
    rows = like.select(*keys).distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(grid.nrows - 1))))
    # rows are dealt out before they become cells, so one key is not one task
    return spread(rows, *keys, "r").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(grid.ncols - 1))))
