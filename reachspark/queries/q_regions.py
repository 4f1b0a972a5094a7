"""Regions, routes, stranding and polygons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators import polygons, regions, routes
from ..plans import lifespan, stranding
from ..session import cut
from .q_plans import BEST, lifespans
from .registry import Data, query, rounded, sql

LIMIT = 50


def region_sql(source: str, keys: str = "", value: str = "", diagonal: bool = False, name: str = "lab_v") -> str:
    """CTE: cells of ``source`` with ``label``, the smallest row-major number of their region."""
    moves = "(values (0,1),(1,0),(0,-1),(-1,0),(1,1),(1,-1),(-1,-1),(-1,1)) s(i,j)" if diagonal else "(values (0,1),(1,0),(0,-1),(-1,0)) s(i,j)"
    k = f"{keys}, " if keys else ""
    ak, on = (f"a.{keys}, ", f"b.{keys} = a.{keys} and ") if keys else ("", "")
    wk, won = (f"w.{keys}, ", f"e.{keys} = w.{keys} and ") if keys else ("", "")
    same = f" and b.{value} = a.{value}" if value else ""
    # Seeds are the cells with no region cell before them in row-major order among their neighbours.
    return f"""{name}_e as (select {ak}a.r * 128 + a.c id, b.r * 128 + b.c nb from {source} a, {moves} join {source} b on {on}b.r = a.r + i and b.c = a.c + j{same}),
      {name}_w as (select {k}r * 128 + c id, r * 128 + c label from {source} a where not exists (select 1 from {name}_e e where {f'e.{keys} = a.{keys} and ' if keys else ''}e.id = a.r * 128 + a.c and e.nb < e.id)
        union select {wk}e.nb, w.label from {name}_w w join {name}_e e on {won}e.id = w.id),
      {name} as (select m.*, label from {source} m join (select {k}id, min(label) label from {name}_w group by {k}id) w on {f'w.{keys} = m.{keys} and ' if keys else ''}w.id = m.r * 128 + m.c)"""


def rsql(*views: str, body: str, ctes: str) -> str:
    return sql(*views, body=body, ctes=ctes).replace("with ", "with recursive ", 1)


WET = f"wet_v as (select r, c from cells_v where z > {LIMIT}),"


@query("label_regions", rsql("cells_v", ctes=WET + region_sql("wet_v"), body="select r, c, cast(label as bigint) label from lab_v"))
def label_query(d: Data):
    return regions.label_regions(d.layer().filter(F.col("v") > LIMIT), d.grid)


@query("label_regions_diagonal", rsql("cells_v", ctes=WET.replace("> 50", "> 60") + region_sql("wet_v", diagonal=True), body="select r, c, cast(label as bigint) label from lab_v"))
def label_diagonal(d: Data):
    return regions.label_regions(d.layer().filter("v > 60"), d.grid, 8)


@query("label_regions_small_tiles", rsql("cells_v", ctes=WET + region_sql("wet_v"), body="select r, c, cast(label as bigint) label from lab_v"))
def label_small_tiles(d: Data):
    """Many tiles and no one-task finish: all merging happens by contraction."""
    return regions.label_regions(d.layer().filter(F.col("v") > LIMIT), d.grid, tile=16, one_task_edges=0)


@query(
    "region_sizes",
    rsql("cells_v", ctes=WET + region_sql("wet_v"), body="select cast(label as bigint) label, count(*) cells from lab_v group by 1"),
)
def sizes(d: Data):
    return regions.region_sizes(label_query(d))


@query(
    "largest_region",
    rsql("cells_v", ctes=WET + region_sql("wet_v"), body="select cast(label as bigint) label, count(*) cells from lab_v group by label qualify row_number() over (order by count(*) desc, label) = 1"),
)
def largest(d: Data):
    return regions.largest_region(label_query(d))


@query(
    "disconnected_mask",
    rsql(
        "cells_v",
        ctes=WET + region_sql("wet_v") + ", big_v as (select label from lab_v group by 1 order by count(*) desc, 1 limit 1)",
        body="select r, c, cast(label as bigint) label from lab_v where label not in (select label from big_v)",
    ),
)
def disconnected_query(d: Data):
    return regions.disconnected(cut(label_query(d)))


@query(
    "disconnected_from_target",
    rsql(
        "cells_v",
        ctes=WET + region_sql("wet_v") + ", hit_v as (select distinct label from lab_v join cells_v using (r, c) where z > 95)",
        body="select r, c, cast(label as bigint) label from lab_v where label not in (select label from hit_v)",
    ),
)
def disconnected_target(d: Data):
    return regions.disconnected(cut(label_query(d)), d.layer().filter("v > 95").select("r", "c"))


@query(
    "polygonize",
    rsql(
        "cells_v",
        ctes="val_v as (select r, c, cast(trunc(z / 34) as int) g from cells_v),"
        + region_sql("val_v", value="g")
        + """, per_v as (select l.label, count(*) p from lab_v l, (values (0,1),(1,0),(0,-1),(-1,0)) s(i,j) left join lab_v n on n.r = l.r + i and n.c = l.c + j and n.label = l.label where n.r is null group by 1)""",
        body="""select cast(label as bigint) label, min(g) gridcode, count(*) cells, cast(count(*) as double) area, cast(min(p) as double) perimeter from lab_v join per_v using (label) group by 1""",
    ),
)
def polygonize_query(d: Data):
    return polygons.polygonize(d.layer().select("r", "c", (F.col("v") / 34).alias("v")), d.grid)


@query("region_outlines")
def outlines_query(d: Data):
    return polygons.outlines(cut(label_query(d)), d.grid)


@query(
    "outline_areas",
    rsql("cells_v", ctes=WET + region_sql("wet_v"), body="select cast(label as bigint) label, true closed, cast(count(*) as double) area from lab_v group by 1"),
)
def outline_areas(d: Data):
    """Every ring is closed, and the rings of a region enclose the area of its cells."""
    rings = outlines_query(d)
    along = Window.partitionBy("label", "ring").orderBy("seq")
    turn = F.col("x") * F.lead("y").over(along) - F.lead("x").over(along) * F.col("y")
    per_ring = rings.withColumn("turn", turn).groupBy("label", "ring").agg(
        F.sum("turn").alias("turn"),
        (F.min_by(F.struct("x", "y"), "seq") == F.max_by(F.struct("x", "y"), "seq")).alias("closed"),
    )
    return per_ring.groupBy("label").agg(F.bool_and("closed").alias("closed"), (F.abs(F.sum("turn")) / 2.0).alias("area"))


H_MIN = 4.6
STRAND = (
    f"wq_v as (select q, r, c from hydraulics_v where h > {H_MIN}),"
    + region_sql("wq_v", keys="q")
    + """, main_v as (select r, c from lab_v where q = (select min(q) from hydraulics_v) and label = (select label from lab_v where q = (select min(q) from hydraulics_v) group by 1 order by count(*) desc, 1 limit 1)),
  sz_v as (select q, label, count(*) n from lab_v group by 1, 2),
  hit_v as (select distinct q, label from lab_v join main_v using (r, c)),
  con_v as (select * from hit_v union all select q, arg_max(label, struct_pack(n := n, l := -label)) from sz_v where q not in (select q from hit_v) group by 1),
  lost_v as (select l.* from lab_v l left join con_v k on k.q = l.q and k.label = l.label where k.q is null),
  per_v as (select h.q, coalesce(w, 0.0) wetted_area, coalesce(s, 0.0) stranded_area, coalesce(p, 0) pools from (select distinct q from hydraulics_v) h
    left join (select q, count(*) * 1.0 w from lab_v group by 1) using (q) left join (select q, count(*) * 1.0 s, count(distinct label) p from lost_v group by 1) using (q))"""
)


def strand(d: Data, **options):
    return stranding.stranding(d.hydraulics.drop("ux", "uy"), d.grid, H_MIN, **options)


@query(
    "stranding",
    rsql(
        "hydraulics_v",
        ctes=STRAND,
        body="""select q, cast(wetted_area as double) wetted_area, cast(stranded_area as double) stranded_area, pools, round(case when wetted_area > 0 then stranded_area / wetted_area * 100 else 0 end, 6) percent_stranded,
          round(stranded_area / (select max(wetted_area) from per_v) * 100, 6) percent_of_max_wetted from per_v""",
    ),
)
def stranding_query(d: Data):
    return rounded(strand(d).per_discharge)


@query("q_disconnect", rsql("hydraulics_v", ctes=STRAND, body="select r, c, max(q) q_disconnect from lost_v group by 1, 2"))
def q_disconnect(d: Data):
    return strand(d).q_disconnect


@query(
    "stranding_summary",
    rsql(
        "hydraulics_v",
        ctes=STRAND,
        body="""select arg_max(q, struct_pack(s := stranded_area, q := q)) worst_discharge, cast(max(stranded_area) as double) worst_stranded_area, cast(max(wetted_area) as double) max_wetted_area,
          (select cast(count(*) as double) from (select distinct r, c from lost_v)) total_disconnected_area, false velocity_limited from per_v""",
    ),
)
def stranding_summary(d: Data):
    return strand(d).summary


@query("main_channel", rsql("hydraulics_v", ctes=STRAND, body="select r, c from main_v"))
def main_channel_query(d: Data):
    labelled = cut(regions.label_regions(stranding.wetted(d.hydraulics, H_MIN), d.grid, keys=["q"]))
    return stranding.main_channel(labelled)


@query(
    "stranding_pools",
    rsql("hydraulics_v", ctes=STRAND, body="select q, cast(label as bigint) label, count(*) cells, cast(count(*) as double) area from lost_v group by 1, 2 order by 4 desc, 1, 2"),
)
def pools_query(d: Data):
    return stranding.pools(strand(d).stranded, d.grid).drop("perimeter")


@query(
    "travel_rule",
    sql(
        "hydraulics_v",
        body="""select q, r, c, ux >= -1.5 east, (ux - uy) / sqrt(2) >= -1.5 south_east, -uy >= -1.5 south, (-ux - uy) / sqrt(2) >= -1.5 south_west,
          -ux >= -1.5 west, (-ux + uy) / sqrt(2) >= -1.5 north_west, uy >= -1.5 north, (ux + uy) / sqrt(2) >= -1.5 north_east from hydraulics_v""",
    ),
)
def rule_query(d: Data):
    g = Grid(1, 1)
    rule = routes.travel_rule(g, 1.5)
    names = {(0, 1): "east", (1, 1): "south_east", (1, 0): "south", (1, -1): "south_west", (0, -1): "west", (-1, -1): "north_west", (-1, 0): "north", (-1, 1): "north_east"}
    return d.hydraulics.select("q", "r", "c", *[rule(*step).alias(name) for step, name in names.items()])


MOVES = "(values (0,1,ux),(1,0,-uy),(0,-1,-ux),(-1,0,uy)) s(i,j,along)"
COSTS = """pass_v as (select r, c from cells_v where z > 30),
  step_v as (select p.r r1, p.c c1, n.r r2, n.c c2, sqrt(abs(i) + abs(j)) w from pass_v p, (values (0,1),(1,0),(0,-1),(-1,0),(1,1),(1,-1),(-1,-1),(-1,1)) s(i,j)
    join pass_v n on n.r = p.r + i and n.c = p.c + j),
  way_v(r, c, cost) using key (r, c) as (select r, c, 0.0::double from cells_v where z > 99
    union select s.r2, s.c2, min(w.cost + s.w) from way_v w join step_v s on s.r1 = w.r and s.c1 = w.c left join recurring.way_v o on o.r = s.r2 and o.c = s.c2
      where o.cost is null or w.cost + s.w < o.cost - 1e-9 group by s.r2, s.c2)"""


@query("least_cost_distance", rsql("cells_v", ctes=COSTS, body="select r, c, round(cost, 6) cost from way_v"))
def least_cost(d: Data):
    cells = d.layer()
    return rounded(routes.least_cost_distance(cells.filter("v > 30"), cells.filter("v > 99"), d.grid))


@query("least_cost_distance_small_tiles", rsql("cells_v", ctes=COSTS, body="select r, c, round(cost, 6) cost from way_v"))
def least_cost_small_tiles(d: Data):
    """Most routes cross tile borders."""
    cells = d.layer()
    return rounded(routes.least_cost_distance(cells.filter("v > 30"), cells.filter("v > 99"), d.grid, tile=16))


# A cell steps towards the channel if the current along that step is not stronger against it than allowed.
ESCAPE = (
    STRAND
    + f""", flow_at as (select h.q, h.r, h.c, h.ux, h.uy from hydraulics_v h join wq_v using (q, r, c)),
  back_v as (select f.q, f.r r1, f.c c1, f.r + i r2, f.c + j c2 from flow_at f, lateral (select * from {MOVES}) where along >= -2.5),
  way_v(q, r, c, cost) using key (q, r, c) as (select q, r, c, 0.0::double from lab_v where (r, c) in (select (r, c) from main_v)
    union select b.q, b.r1, b.c1, min(w.cost + 1) from way_v w join back_v b on b.q = w.q and b.r2 = w.r and b.c2 = w.c left join recurring.way_v o on o.q = b.q and o.r = b.r1 and o.c = b.c1
      where o.cost is null or w.cost + 1 < o.cost - 1e-9 group by b.q, b.r1, b.c1)"""
)


@query("escape_routes", rsql("hydraulics_v", ctes=ESCAPE, body="select q, r, c, round(cost, 6) cost from way_v"))
def escape(d: Data):
    flow = d.hydraulics
    labelled = cut(regions.label_regions(stranding.wetted(flow, H_MIN), d.grid, keys=["q"]))
    return rounded(stranding.escape_routes(flow, labelled, d.grid, cut(stranding.main_channel(labelled)), 2.5))


@query(
    "stranding_velocity",
    rsql(
        "hydraulics_v",
        ctes=ESCAPE
        + """, cut_v as (select l.q, l.r, l.c from lab_v l left join way_v w on w.q = l.q and w.r = l.r and w.c = l.c where w.q is null), """
        + region_sql("cut_v", keys="q", name="pool_v")
        + """, vel_v as (select h.q, coalesce(w, 0.0) wetted_area, coalesce(s, 0.0) stranded_area, coalesce(p, 0) pools from (select distinct q from hydraulics_v) h
    left join (select q, count(*) * 1.0 w from lab_v group by 1) using (q) left join (select q, count(*) * 1.0 s, count(distinct label) p from pool_v group by 1) using (q))""",
        body="""select q, cast(wetted_area as double) wetted_area, cast(stranded_area as double) stranded_area, pools, round(case when wetted_area > 0 then stranded_area / wetted_area * 100 else 0 end, 6) percent_stranded,
          round(stranded_area / (select max(wetted_area) from vel_v) * 100, 6) percent_of_max_wetted from vel_v""",
    ),
)
def strand_velocity(d: Data):
    return rounded(stranding.stranding(d.hydraulics, d.grid, H_MIN, u_max=2.5).per_discharge)


@query(
    "best_feature_polygons",
    rsql(
        "cells_v",
        "hydraulics_v",
        ctes=BEST
        + ", bf_v as (select fid, r, c from best_v where lifespan = best), "
        + region_sql("bf_v", keys="fid")
        + """, per_v as (select l.fid, l.label, count(*) p from lab_v l, (values (0,1),(1,0),(0,-1),(-1,0)) s(i,j) left join lab_v n on n.fid = l.fid and n.r = l.r + i and n.c = l.c + j and n.label = l.label where n.r is null group by 1, 2)""",
        body="""select l.fid, cast(l.label as bigint) label, cast(1 as int) gridcode, count(*) cells, cast(count(*) as double) area, cast(min(p) as double) perimeter from lab_v l join per_v p on p.fid = l.fid and p.label = l.label group by 1, 2""",
    ),
)
def best_polygons(d: Data):
    best = lifespans(d, best=True)
    coded = best.select("fid", "r", "c", F.lit(1).alias("v"))
    return rounded(polygons.polygonize(coded, d.grid, keys=["fid"]))
