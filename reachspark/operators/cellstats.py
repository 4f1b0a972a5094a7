"""Statistics over stacks, classes and zones of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import class_index

STATISTICS = ("MAXIMUM", "MINIMUM", "MEAN", "SUM", "MEDIAN", "STD", "RANGE")


def cell_statistics(
    stack: DataFrame,
    statistic: str = "MAXIMUM",
    ignore_nodata: bool = True,
    layers: int | None = None,
    value: str = "v",
    keys: Sequence[str] = (),
) -> DataFrame:
    """One value per cell across a stack of layers.

    ``stack`` holds one row per layer and valid cell. With ``ignore_nodata=False`` a cell
    missing from any of the ``layers`` layers becomes NULL.
    """
    name = statistic.upper()
    v = F.col(value)
    makers = {
        "MAXIMUM": lambda: F.max(v),
        "MINIMUM": lambda: F.min(v),
        "MEAN": lambda: F.avg(v),
        "SUM": lambda: F.sum(v),
        "MEDIAN": lambda: F.median(v),
        "STD": lambda: F.stddev_pop(v),
        "RANGE": lambda: F.max(v) - F.min(v),
    }
    if name not in makers:
        raise ValueError(f"unsupported statistic {statistic!r}")
    out = makers[name]()
    if not ignore_nodata:
        if layers is None:
            raise ValueError("strict statistics need the number of layers")
        out = F.when(F.count(v) == layers, out)
    return stack.groupBy(*keys, "r", "c").agg(out.alias(value))


def tabulate_area(cells: DataFrame, breaks: Sequence[float], cell_area: float, value: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Area per class; intervals are closed on the left."""
    classed = cells.select(*keys, class_index(value, breaks, right=False).alias("class"))
    counted = classed.filter(F.col("class").isNotNull()).groupBy(*keys, "class")
    return counted.agg((F.count(F.lit(1)) * F.lit(cell_area)).alias("area"))


def zonal_statistics(zone_cells: DataFrame, cells: DataFrame, zones: DataFrame | None = None, zone: str = "zone", value: str = "v") -> DataFrame:
    """count, mean, min, max and sum of the cells in each zone.

    ``zone_cells`` maps (r, c) to zones (see ``polygons.rasterize``). Zones of ``zones``
    without a valid cell are kept with count 0.
    """
    hit = zone_cells.join(cells.select("r", "c", F.col(value).alias("_v")), ["r", "c"])
    stats = hit.groupBy(zone).agg(
        F.count("_v").alias("count"),
        F.avg("_v").alias("mean"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.sum("_v").alias("sum"),
    )
    if zones is None:
        return stats
    return zones.select(zone).distinct().join(stats, zone, "left").withColumn("count", F.coalesce("count", F.lit(0)))
