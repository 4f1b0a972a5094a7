"""Fish stranding along a recession: which wetted cells lose their way to the mainstem."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import wet
from ..grid import Grid
from ..operators.polygons import boundary_sides
from ..operators.regions import disconnected, label_regions, largest_region
from ..operators.routes import least_cost_distance, travel_rule
from ..session import cut


@dataclass
class Stranding:
    """Tables of one analysis. ``labelled`` and ``stranded`` carry ``q, r, c, label``."""

    per_discharge: DataFrame
    stranded: DataFrame
    q_disconnect: DataFrame
    summary: DataFrame
    labelled: DataFrame


def wetted(hydraulics: DataFrame, h_min: float) -> DataFrame:
    """Cells deeper than ``h_min`` at each discharge."""
    return hydraulics.filter(wet("h", h_min)).select("q", "r", "c")


def main_channel(labelled: DataFrame, q: float | None = None) -> DataFrame:
    """Cells of the largest region at the given (default: lowest) discharge."""
    if q is None:
        at = labelled.filter(F.col("q") == labelled.agg(F.min("q")).scalar())
    else:
        at = labelled.filter(F.col("q") == F.lit(float(q)))
    return at.join(largest_region(at, ["q"]).select("q", "label"), ["q", "label"], "left_semi").select("r", "c")


def stranding(
    hydraulics: DataFrame,
    grid: Grid,
    h_min: float = 0.2,
    connectivity: int = 4,
    target_q: float | bool | None = None,
    u_max: float | None = None,
) -> Stranding:
    """Walk all discharges at once.

    ``target_q`` names the discharge whose main channel must be reached (default: the lowest
    analysed one; ``False``: each discharge's own largest region). With ``u_max`` and columns
    ``ux, uy`` a cell is stranded when no permitted route leads to the channel; otherwise when
    its region does not touch it.
    """
    labelled = cut(label_regions(wetted(hydraulics, h_min), grid, connectivity, keys=["q"]))
    if target_q is False:
        target = None
    else:
        first = hydraulics.agg(F.min("q")).first()[0] if target_q is None else float(target_q)
        target = main_channel(labelled, first)
    directed = u_max is not None and {"ux", "uy"} <= set(hydraulics.columns)
    if directed:
        routes = escape_routes(hydraulics, labelled, grid, target, u_max, connectivity)
        cells = labelled.join(routes, ["q", "r", "c"], "left_anti").select("q", "r", "c")
        lost = label_regions(cells, grid, connectivity, keys=["q"])
    else:
        lost = disconnected(labelled, target, ["q"])
    lost = cut(lost.select("q", "r", "c", "label"))

    area = F.lit(grid.cell_area)
    wet_area = labelled.groupBy("q").agg((F.count(F.lit(1)) * area).alias("wetted_area"))
    lost_area = lost.groupBy("q", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("q").agg(
        F.count(F.lit(1)).alias("pools"), (F.sum("n") * area).alias("stranded_area")
    )
    table = hydraulics.select("q").distinct().join(wet_area, "q", "left").join(lost_area, "q", "left")
    table = table.na.fill({"wetted_area": 0.0, "stranded_area": 0.0, "pools": 0})
    widest = table.agg(F.max("wetted_area")).scalar()
    share = lambda whole: F.when(whole > 0, F.col("stranded_area") / whole * 100.0).otherwise(F.lit(0.0))
    table = table.withColumn("percent_stranded", share(F.col("wetted_area"))).withColumn("percent_of_max_wetted", share(widest))

    highest = lost.groupBy("r", "c").agg(F.max("q").alias("q_disconnect"))
    total = highest.agg((F.count(F.lit(1)) * area).alias("a")).scalar()
    worst = F.max_by(F.struct("q", "stranded_area"), F.struct("stranded_area", "q"))
    summary = table.agg(worst.alias("w"), F.max("wetted_area").alias("max_wetted_area")).select(
        F.col("w.q").alias("worst_discharge"),
        F.col("w.stranded_area").alias("worst_stranded_area"),
        "max_wetted_area",
        total.alias("total_disconnected_area"),
        F.lit(directed).alias("velocity_limited"),
    )
    return Stranding(table, lost, highest, summary, labelled)


def escape_routes(hydraulics: DataFrame, labelled: DataFrame, grid: Grid, target: DataFrame | None, u_max: float | None = None, connectivity: int = 4) -> DataFrame:
    """``q, r, c, cost``: the shortest permitted way from each wetted cell to the mainstem.

    A discharge whose wetted area does not meet the target has no routes. Without a target the
    largest region of each discharge is the mainstem.
    """
    if target is None:
        seeds = labelled.join(largest_region(labelled, ["q"]).select("q", "label"), ["q", "label"], "left_semi")
    else:
        seeds = labelled.join(target.distinct(), ["r", "c"], "left_semi")
    cells = labelled.select("q", "r", "c")
    rule = None
    if u_max is not None and {"ux", "uy"} <= set(hydraulics.columns):
        cells = cells.join(hydraulics.select("q", "r", "c", "ux", "uy"), ["q", "r", "c"], "left")
        rule = travel_rule(grid, u_max)
    return least_cost_distance(cells, seeds.select("q", "r", "c"), grid, connectivity, rule, True, keys=["q"])


def pools(stranded: DataFrame, grid: Grid, q: float | None = None) -> DataFrame:
    """Pools with cells, area and perimeter, largest first; one discharge or all."""
    if q is not None:
        stranded = stranded.filter(F.col("q") == F.lit(float(q)))
    size = stranded.groupBy("q", "label").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * F.lit(grid.cell_area)).alias("area"))
    length = F.when(F.col("side") % 2 == 0, F.lit(abs(grid.dx))).otherwise(F.lit(abs(grid.dy)))
    rim = boundary_sides(stranded, ["q"]).groupBy("q", "label").agg(F.sum(length).alias("perimeter"))
    return size.join(rim, ["q", "label"]).orderBy(F.desc("area"), "q", "label")
