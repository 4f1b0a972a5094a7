"""Terrain works: lowering ground for plantings, and the volumes a terrain change moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.algebra import level_of_detection, lowered
from ..grid import Grid
from ..operators.align import align_nearest
from ..operators.volume import volumes_both_sides


def lowered_cells(terrain: DataFrame, masks: DataFrame, d2w_max: float = K.DEFAULT_D2W_MAX, keys: Sequence[str] = ()) -> DataFrame:
    """``terrain`` (``r, c, dem, d2w``) with ``fid, cut, dem_new, d2w_new``.

    Once a feature has lowered a cell it lies exactly at the limit, so later features leave it
    alone: the cut belongs to the first planned feature in order. ``masks`` is ``fid, ord, r, c``.
    """
    cell = [*keys, "r", "c"]
    first = masks.groupBy(*cell).agg(F.min_by("fid", "ord").alias("fid"))
    planned = terrain.join(first, cell, "left")
    new = lowered("dem", "d2w", F.col("fid").isNotNull(), d2w_max)
    planned = planned.withColumn("dem_new", new).withColumn("cut", F.coalesce(F.col("dem") - F.col("dem_new"), F.lit(0.0)))
    return planned.withColumn("d2w_new", F.col("d2w") - F.col("cut")).withColumn("fid", F.when(F.col("cut") > 0, F.col("fid")))


def terraforming_summary(cells: DataFrame, cell_area: float, features: DataFrame | None = None) -> DataFrame:
    """Cells, area, volume and deepest cut per feature; every feature of ``features`` is listed."""
    cut = cells.filter("cut > 0").groupBy("fid").agg(
        F.count(F.lit(1)).alias("cells"),
        (F.count(F.lit(1)) * F.lit(cell_area)).alias("area"),
        (F.sum("cut") * F.lit(cell_area)).alias("volume"),
        F.max("cut").alias("max_cut"),
    )
    if features is None:
        return cut
    return features.select("fid").distinct().join(cut, "fid", "left").na.fill(0)


def terraforming_total(cells: DataFrame, cell_area: float) -> DataFrame:
    """The same over all features."""
    hit = F.when(F.col("cut") > 0, F.col("cut"))
    return cells.agg(
        F.count(hit).alias("modified_cells"),
        (F.count(hit) * F.lit(cell_area)).alias("modified_area"),
        (F.coalesce(F.sum(hit), F.lit(0.0)) * F.lit(cell_area)).alias("cut_volume"),
        F.coalesce(F.max(hit), F.lit(0.0)).alias("max_cut"),
    )


def difference(original: DataFrame, modified: DataFrame, grid: Grid, modified_grid: Grid | None = None, unit: str = "us", lod: float | None = None) -> DataFrame:
    """``r, c, v``: modified minus original, changes below the level of detection zeroed."""
    if modified_grid is not None and not modified_grid.same_as(grid):
        modified = align_nearest(modified, modified_grid, grid)
    limit = K.LEVEL_OF_DETECTION[unit] if lod is None else lod
    both = original.select("r", "c", F.col("v").alias("_a")).join(modified.select("r", "c", F.col("v").alias("_b")), ["r", "c"])
    return both.select("r", "c", level_of_detection(F.col("_b") - F.col("_a"), limit).alias("v"))


def fill_and_cut(dod: DataFrame) -> DataFrame:
    """The difference split into ``fill`` and ``excavation`` columns, NULL elsewhere."""
    v = F.col("v")
    return dod.select("r", "c", "v", F.when(v > 0, v).alias("fill"), F.when(v < 0, v).alias("excavation"))


def volume_assessment(dod: DataFrame, grid: Grid, unit: str = "us", legacy_draped: bool = False) -> DataFrame:
    """Fill, excavation and net volume (cubic yards or metres) with their areas."""
    factor = F.lit(1.0 / K.CUBIC_FEET_PER_YARD if unit.lower() == "us" else 1.0)
    v = volumes_both_sides(dod, grid, legacy_draped=legacy_draped)
    return v.select(
        (F.col("volume_above") * factor).alias("fill_volume"),
        (F.col("volume_below") * factor).alias("excavation_volume"),
        ((F.col("volume_above") - F.col("volume_below")) * factor).alias("net_volume"),
        F.col("area_above").alias("fill_area"),
        F.col("area_below").alias("excavation_area"),
        F.col("draped_above").alias("fill_area_3d"),
        F.col("draped_below").alias("excavation_area_3d"),
    )
