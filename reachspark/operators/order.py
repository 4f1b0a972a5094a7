"""Row-major numbering of sparse cells without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid


def row_major_index(cells: DataFrame, grid: Grid, keys: Sequence[str] = (), block: int = 4096) -> DataFrame:
    """Add ``idx``: 0-based position of each cell among the present cells, in row-major order.

    Positions come from counts on three levels (cell in block, block in super-block,
    super-block in grid), each numbered by a small window.
    """
    keys = list(keys)
    lin = F.col("r").cast("bigint") * F.lit(grid.ncols) + F.col("c")
    placed = cells.withColumn("_b", F.floor(lin / block)).withColumn("_s", F.floor(F.col("_b") / block))
    blocks = placed.groupBy(*keys, "_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    supers = blocks.groupBy(*keys, "_s").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(*keys, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_so"))
    inside = Window.partitionBy(*keys, "_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_bo", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    offsets = blocks.join(supers, [*keys, "_s"]).select(*keys, "_b", (F.col("_so") + F.col("_bo")).alias("_off"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("r", "c"))
    numbered = placed.drop("_s").withColumn("_k", rank).join(offsets, [*keys, "_b"])
    return numbered.withColumn("idx", F.col("_off") + F.col("_k") - 1).drop("_b", "_k", "_off")


def thin(cells: DataFrame, grid: Grid, step: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Every ``step``-th present cell in row-major order."""
    if step <= 1:
        return cells
    return row_major_index(cells, grid, keys).filter(F.col("idx") % step == 0).drop("idx")


def cell_points(cells: DataFrame, grid: Grid, step: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Centre coordinates of the (thinned) cells, next to their values."""
    return thin(cells, grid, step, keys).withColumn("x", grid.x("c")).withColumn("y", grid.y("r"))
