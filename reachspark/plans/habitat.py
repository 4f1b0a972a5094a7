"""Fish habitat: suitability per cell, usable area per discharge, seasonal habitat area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import algebra
from ..grid import Grid
from ..operators.stencil import focal_fraction, grid_cells, within_radius
from ..session import cut, deal

Curve = Sequence[tuple[float, float]]


def composite_suitability(hydraulics: DataFrame, depth_curve: Curve, velocity_curve: Curve, cover: DataFrame | None = None, method: str = "geometric_mean", keys: Sequence[str] = ("q",), keep_dry: bool = False) -> DataFrame:
    """``keys, r, c, chsi`` of the wet cells with both depth and velocity.

    ``cover`` (``keys, r, c, cover``) multiplies in where given; wet cells without cover have
    no suitability then. Cells without suitability are dropped unless ``keep_dry``, which keeps
    them as NULL so that later aggregates see every discharge in the same scan.
    """
    cell = [*keys, "r", "c"]
    rows = hydraulics.select(*cell, "h", "u").filter("h IS NOT NULL AND u IS NOT NULL" if keep_dry else "h > 0 AND u IS NOT NULL")
    if cover is not None:
        rows = rows.join(cover, [k for k in cell if k in cover.columns], "left" if keep_dry else "inner")
    rows = rows.withColumn("_d", algebra.apply_curve("h", depth_curve)).withColumn("_v", algebra.apply_curve("u", velocity_curve))
    chsi = algebra.composite_hsi("h", "_d", "_v", "cover" if cover is not None else None, method)
    out = rows.select(*cell, chsi.alias("chsi"))
    return out if keep_dry else out.filter("chsi IS NOT NULL")


def usable_area(chsi: DataFrame, cell_area: float, threshold: float = 0.4, weighted: bool = False, keys: Sequence[str] = ("q",)) -> DataFrame:
    """``usable_area, mean_chsi`` per discharge; NULL suitability counts as none.

    Usable cells exceed the threshold; ``weighted`` multiplies by their mean suitability.
    """
    good = F.col("chsi") > F.lit(threshold)
    area = F.count(F.when(good, True)) * F.lit(cell_area)
    if weighted:
        area = area * F.coalesce(F.avg(F.when(good, F.col("chsi"))), F.lit(1.0))
    mean = F.coalesce(F.avg("chsi"), F.lit(0.0))
    return chsi.groupBy(*keys).agg(area.cast("double").alias("usable_area"), mean.alias("mean_chsi"))


def seasonal_area(areas: DataFrame, duration: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``sharea``: usable area integrated over exceedance, rarest discharge first.

    Discharges without an exceedance are left out. Equal exceedances are ordered by discharge.
    """
    keys = list(keys)
    shared = ["q", *[k for k in keys if k in areas.columns and k in duration.columns]]
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("exceedance", "q")
    paired = areas.join(duration, shared).withColumn("_p", F.lag("exceedance", 1, 0.0).over(w))
    total = F.sum((F.col("exceedance") - F.col("_p")) / 100.0 * F.col("usable_area"))
    return paired.groupBy(*keys).agg(F.coalesce(total, F.lit(0.0)).alias("sharea"))


def derived_presence(grain: DataFrame, cover: str, unit: str = "us") -> DataFrame:
    """Cells whose grain size makes them cobbles or boulders."""
    return grain.filter(in_grain_range("v", cover, unit))


def in_grain_range(v: str, cover: str, unit: str = "us") -> Column:
    """Is a grain size that of cobbles or boulders?"""
    low, high = (limit * K.length_factor(unit) for limit in K.GRAIN_LIMITS_M[cover])
    return (F.col(v) >= F.lit(low)) & (F.col(v) < F.lit(high))


def cover_suitability(
    layers: DataFrame,
    curves: Mapping[str, Curve],
    grid: Grid,
    unit: str = "us",
    depth: DataFrame | None = None,
    h_min: float = 0.0,
    mineral_rule: str = "radius",
    window: int = 1,
    keys: Sequence[str] = ("q",),
) -> DataFrame:
    """``keys, r, c, cover, kinds``: the best shelter at each cell and how many kinds offer one.

    ``layers`` is ``cover, r, c, v``; ``curves`` gives a suitability curve for ``substrate``
    and, for the others, a list whose first point is (radius or share, suitability). With
    ``depth`` (``keys, r, c, h``) only cells at least ``h_min`` deep are reachable, per key.
    """
    if mineral_rule not in ("radius", "fraction"):
        raise ValueError("mineral_rule must be radius or fraction")
    keys = list(keys) if depth is not None else []
    cell = [*keys, "r", "c"]
    asked = [c for c in K.COVER_ORDER if curves.get(c)] + ["substrate"]
    present = {row["cover"] for row in layers.filter(F.col("cover").isin(asked)).select("cover").distinct().collect()}
    scores, radii, derived = {}, {}, []
    for cover in K.COVER_ORDER:
        if not curves.get(cover) or cover == "substrate":
            continue
        if cover not in present:
            if cover not in K.MINERAL_COVER or "substrate" not in present:
                continue
            derived.append(cover)
        radii[cover], scores[cover] = (float(x) for x in sorted(curves[cover])[0])
    if not scores and not (curves.get("substrate") and "substrate" in present):
        raise ValueError("no cover layer has a curve")

    # every kind a cell offers, from one scan, and one join with depth
    substrate = F.col("cover") == "substrate"
    kinds = [F.when(substrate, F.lit("substrate")), F.when(~substrate & (F.col("v") > 0) & F.col("cover").isin(list(scores)), F.col("cover"))]
    kinds += [F.when(substrate & in_grain_range("v", cover, unit), F.lit(cover)) for cover in derived]
    offered = layers.filter(F.col("cover").isin([*scores, "substrate"])).withColumn("kind", F.explode(F.array_compact(F.array(*kinds))))
    offered = offered.select("r", "c", "kind", "v")
    if depth is not None:
        offered = cut(offered.join(depth.filter(F.col("h") >= F.lit(float(h_min))).select(*cell), ["r", "c"]))

    by_share = {c for c in scores if c in K.MINERAL_COVER and mineral_rule == "fraction"}
    by_radius = {c: radii[c] for c in scores if c not in by_share}
    parts = []
    if curves.get("substrate") and "substrate" in present:
        graded = offered.filter("kind = 'substrate'").withColumn("cover", algebra.apply_curve("v", curves["substrate"]))
        parts.append(graded.select(*cell, "cover"))
    if by_radius:
        near = within_radius(offered.select(*cell, "kind"), grid, by_radius, [*keys, "kind"])
        score = F.coalesce(*[F.when(F.col("kind") == c, F.lit(scores[c])) for c in by_radius])
        parts.append(near.select(*cell, score.alias("cover")))
    for cover in sorted(by_share):
        if "substrate" in present:
            ground = offered.filter("kind = 'substrate'").select(*cell)
        else:
            ground = grid_cells(layers, grid)
            ground = ground if depth is None else ground.join(depth.filter(F.col("h") >= F.lit(float(h_min))).select(*cell), ["r", "c"])
        marked = ground.join(offered.filter(F.col("kind") == cover).select(*cell).withColumn("present", F.lit(True)), cell, "left")
        share = focal_fraction(marked, grid, window, keys=keys).filter(F.col("fraction") > F.lit(radii[cover]))
        parts.append(share.select(*cell, F.lit(scores[cover]).alias("cover")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # a kind gives a cell one row at most
    return deal(out, *cell).groupBy(*cell).agg(F.max("cover").alias("cover"), F.count("*").alias("kinds"))


def habitat(
    hydraulics: DataFrame,
    depth_curve: Curve,
    velocity_curve: Curve,
    cell_area: float,
    duration: DataFrame | None = None,
    cover: DataFrame | None = None,
    method: str = "geometric_mean",
    threshold: float = 0.4,
    weighted: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Usable area per discharge and, with a duration table, the seasonal habitat area."""
    chsi = composite_suitability(hydraulics, depth_curve, velocity_curve, cover, method, keep_dry=True)
    areas = usable_area(chsi, cell_area, threshold, weighted)
    return areas, None if duration is None else seasonal_area(areas, duration)
