"""Products a condition needs before it can be analysed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import shear
from ..functions.algebra import as_col, con, wet
from ..grid import Grid
from ..operators.align import align_condition, align_nearest
from ..operators.knn import idw, kriging
from ..operators.nearest import nearest_source
from ..operators.order import thin
from ..operators.stencil import grid_cells
from ..session import Guard
from ..sources.definitions import definition_lines
from .duration import seasonal_duration


def interpolate(targets: DataFrame, sources: DataFrame, grid: Grid, method: str = "nearest", keys: Sequence[str] = (), **options) -> DataFrame:
    """``keys, r, c, v`` at the target cells from the source cells."""
    if method == "nearest":
        found = nearest_source(targets, sources, grid, keys=keys)
    elif method == "idw":
        found = idw(targets, sources, grid, keys=keys, **options)
    elif method == "kriging":
        if keys:
            raise ValueError("kriging fits one surface at a time")
        found = kriging(targets, sources, grid, **options)
    else:
        raise ValueError("method must be nearest, idw or kriging")
    return found.select(*keys, "r", "c", "v")


def detrended_dem(dem: DataFrame, depth: DataFrame, grid: Grid, method: str = "nearest", step: int = 1, **options) -> DataFrame:
    """``r, c, v``: elevation above the bed of the nearest wet cell.

    ``dem`` is ``r, c, v``, ``depth`` is ``r, c, h`` at a low flow.
    """
    bed = dem.join(depth.filter(wet("h")).select("r", "c"), ["r", "c"], "left_semi")
    surface = interpolate(dem, thin(bed, grid, step), grid, method, **options)
    return dem.join(surface.withColumnRenamed("v", "_s"), ["r", "c"]).select("r", "c", (F.col("v") - F.col("_s")).alias("v"))


def water_surface(dem: DataFrame, depth: DataFrame, grid: Grid, method: str = "nearest", step: int = 1, keys: Sequence[str] = (), everywhere: bool = True, **options) -> DataFrame:
    """``keys, r, c, v``: terrain plus depth where wet, interpolated elsewhere.

    ``depth`` may hold many discharges at once (``keys=["q"]``). ``everywhere`` fills the whole
    grid, otherwise only cells with terrain.
    """
    level = depth.filter(wet("h")).join(dem, ["r", "c"]).select(*keys, "r", "c", (F.col("v") + F.col("h")).alias("v"))
    points = thin(level, grid, step, keys)
    if everywhere:
        targets = grid_cells(depth if keys else dem, grid, keys)
    elif keys:
        every = depth.agg(F.collect_set(F.struct(*keys)).alias("k")).scalar()
        targets = dem.select("r", "c", F.explode(every).alias("k")).select("k.*", "r", "c")
    else:
        targets = dem
    return interpolate(targets, points, grid, method, keys, **options)


def extended_depth(dem: DataFrame, surface: DataFrame) -> DataFrame:
    """Depth of the interpolated water surface, where positive."""
    joined = dem.join(surface.withColumnRenamed("v", "_w"), ["r", "c"])
    return joined.select("r", "c", con(F.col("_w") - F.col("v") > 0, F.col("_w") - F.col("v")).alias("v")).filter("v IS NOT NULL")


def depth_to_water(dem: DataFrame, surface: DataFrame) -> DataFrame:
    """Height of the ground above the water table; negative under water."""
    joined = dem.join(surface.withColumnRenamed("v", "_w"), ["r", "c"])
    return joined.select("r", "c", (F.col("v") - F.col("_w")).alias("v"))


class UnitRange(NamedTuple):
    """Depth and velocity range of a morphological unit, in metres."""

    name: str
    code: int
    h_min: float | None = None
    h_max: float | None = None
    u_min: float | None = None
    u_max: float | None = None


def unit_code(h, u, units: Iterable[UnitRange], unit: str = "us") -> Column:
    """Code of the morphological unit of a wet cell; the highest code wins overlaps."""
    factor = K.length_factor(unit)
    h, u = as_col(h), as_col(u)
    hits = [
        F.when(
            (h > 0) & (h >= m.h_min * factor) & (h < m.h_max * factor) & (u >= m.u_min * factor) & (u < m.u_max * factor), F.lit(m.code)
        )
        for m in classifiable(units)
    ]
    if not hits:
        raise ValueError("no unit has a depth and velocity range")
    return hits[0] if len(hits) == 1 else F.greatest(*hits)


def classifiable(units: Iterable[UnitRange]) -> list[UnitRange]:
    """Units with a complete depth and velocity range."""
    return [m for m in units if None not in (m.h_min, m.h_max, m.u_min, m.u_max)]


def morphological_units(hydraulics: DataFrame, units: Iterable[UnitRange], unit: str = "us", keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """``keys, r, c, mu``; ``strict`` fails when nothing can be classified."""
    out = hydraulics.select(*keys, "r", "c", unit_code("h", "u", list(units), unit).alias("mu")).filter("mu IS NOT NULL")
    if strict and out.isEmpty():
        raise ValueError("no cell falls into any morphological unit: check the units of depth and velocity")
    return out


def bed_shear_stress(hydraulics: DataFrame, grain: DataFrame, unit: str = "us", grain_kind: str = "dmean", keys: Sequence[str] = ("q",), guard: Guard | None = None, **closure) -> DataFrame:
    """``keys, r, c, ustar2, theta84, h_over_ks, regime`` on the grain layer's cells.

    Dry cells and cells without flow data are invalid (regime 0); a ``guard`` tells if all are, at every discharge.
    """
    flow = hydraulics.select(*keys, "r", "c", F.when(F.col("h") > 0, F.col("h")).alias("h"), "u")
    rows = flow.join(grain.select("r", "c", F.col("v").alias("_grain")), ["r", "c"])
    rows = shear.with_bed_shear(rows, shear.d84("_grain", grain_kind), g=K.gravity(unit), **closure)
    rows = rows if guard is None else guard.watch(rows, "theta84")
    return rows.select(*keys, "r", "c", "ustar2", "theta84", "h_over_ks", "regime")


def regime_summary(shear_cells: DataFrame, grid_size: int | None = None, keys: Sequence[str] = ("q",)) -> DataFrame:
    """Cells per resistance regime, all four labels, one row per key.

    With the number of grid cells given, cells without a row count as invalid.
    """
    counts = [F.count(F.when(F.col("regime") == code, True)).alias(label) for code, label in K.REGIMES.items()]
    out = shear_cells.groupBy(*keys).agg(*counts)
    if grid_size is not None:
        rest = F.lit(grid_size) - sum((F.col(f"`{label}`") for label in list(K.REGIMES.values())[2:]), F.col(f"`{K.REGIMES[1]}`"))
        out = out.withColumn(K.REGIMES[0], rest)
    return out


def standalone_shear(velocity: DataFrame, v_grid: Grid, depth: DataFrame, h_grid: Grid, grain: DataFrame, d_grid: Grid, grain_kind: str = "dmean", unit: str = "si", **closure) -> DataFrame:
    """Bed shear of three layers on different grids; the velocity grid is the reference."""
    h = depth if h_grid.same_as(v_grid) else align_nearest(depth, h_grid, v_grid)
    d = grain if d_grid.same_as(v_grid) else align_nearest(grain, d_grid, v_grid)
    rows = velocity.select("r", "c", F.col("v").alias("u")).join(h.select("r", "c", F.col("v").alias("h")), ["r", "c"], "left")
    rows = rows.join(d.select("r", "c", F.col("v").alias("_grain")), ["r", "c"], "left")
    rows = shear.with_bed_shear(rows, shear.d84("_grain", grain_kind), g=K.gravity(unit), **closure)
    return rows.select("r", "c", "ustar2", "theta84", "h_over_ks", "regime")


def build_product(
    key: str,
    dem: DataFrame | None = None,
    hydraulics: DataFrame | None = None,
    grid: Grid | None = None,
    q: float | None = None,
    method: str = "nearest",
    unit: str = "us",
    grain: DataFrame | None = None,
    units: Iterable[UnitRange] = (),
    flow: DataFrame | None = None,
    seasons: DataFrame | None = None,
    discharges: DataFrame | None = None,
    periods: DataFrame | None = None,
    layers: DataFrame | None = None,
    layer_grids: dict[str, Grid] | None = None,
) -> dict[str, DataFrame]:
    """The tables of one named product of a condition.

    ``detrended``, ``water`` and ``mu`` need ``dem, hydraulics, grid``; ``taux`` needs ``hydraulics, grain``;
    ``flows`` needs ``flow, seasons, discharges``; ``inp`` needs ``discharges`` and, if known, ``periods``;
    ``align`` needs ``layers, layer_grids`` and moves them to ``grid``.
    """

    def need(**given) -> None:
        missing = [n for n, v in given.items() if v is None]
        if missing:
            raise ValueError(f"product {key!r} needs {', '.join(missing)}")

    if key == "flows":
        need(flow=flow, seasons=seasons, discharges=discharges)
        return {"duration": seasonal_duration(flow, seasons, discharges)}
    if key == "inp":
        need(discharges=discharges)
        return {"definitions": definition_lines(discharges, periods)}
    if key == "align":
        need(layers=layers, layer_grids=layer_grids, grid=grid)
        return {"layers": align_condition(layers, layer_grids, grid)}
    if key == "taux":
        need(hydraulics=hydraulics, grain=grain)
        return {"shear": bed_shear_stress(hydraulics, grain, unit)}
    if key not in ("detrended", "water", "mu"):
        raise ValueError(f"unknown product {key!r}")
    need(dem=dem, hydraulics=hydraulics, grid=grid)
    at = hydraulics if q is None else hydraulics.filter(F.abs(F.col("q") - F.lit(float(q))) < 1e-6)
    if key == "detrended":
        return {"dem_detrend": detrended_dem(dem, at, grid, method)}
    if key == "mu":
        return {"mu": morphological_units(at, units, unit)}
    level = water_surface(dem, at, grid, method)
    return {"wle": level, "h_interp": extended_depth(dem, level), "d2w": depth_to_water(dem, level)}
