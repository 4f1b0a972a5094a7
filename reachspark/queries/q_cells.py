"""Stacks, neighbourhoods, alignment, polygons and interpolation on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..operators import align, cellstats, knn, nearest, order, polygons, stencil, volume
from ..plans import terrain
from .registry import Data, query, rounded, sql

STATS = {
    "MAXIMUM": "max(h)",
    "MINIMUM": "min(h)",
    "MEAN": "avg(h)",
    "SUM": "sum(h)",
    "MEDIAN": "median(h)",
    "STD": "stddev_pop(h)",
    "RANGE": "max(h) - min(h)",
}
for _name, _text in STATS.items():

    def _one(d: Data, _name=_name) -> DataFrame:
        return rounded(cellstats.cell_statistics(d.hydraulics.select("q", "r", "c", F.col("h").alias("v")), _name))

    query(f"cell_statistics_{_name.lower()}", sql("hydraulics_v", body=f"select r, c, round({_text}, 6) + 0.0 v from hydraulics_v group by r, c"))(_one)


@query(
    "cell_statistics_strict",
    sql("hydraulics_v", body="select r, c, case when count(h) = 7 then round(max(h) - min(h), 6) + 0.0 end v from hydraulics_v group by r, c"),
)
def strict(d: Data):
    stack = d.hydraulics.select("q", "r", "c", F.col("h").alias("v"))
    return rounded(cellstats.cell_statistics(stack, "RANGE", ignore_nodata=False, layers=7))


@query(
    "tabulate_area",
    sql("cells_v", body="""select cast(case when d2w < 2 then 0 when d2w < 5 then 1 when d2w < 10 then 2 else 3 end as int) class, count(*) * 9.0 area from cells_v group by 1"""),
)
def tabulate(d: Data):
    return cellstats.tabulate_area(d.layer("d2w"), [2.0, 5.0, 10.0], 9.0)


EDGE = """
  w_v as (select a.r, a.c, a.z, (select avg(z) from cells_v) m, (select max(r) from cells_v) mr,
      n.z up, s.z down, w.z wz, e.z ez
    from cells_v a left join cells_v n on n.r = a.r - 1 and n.c = a.c left join cells_v s on s.r = a.r + 1 and s.c = a.c
      left join cells_v w on w.r = a.r and w.c = a.c - 1 left join cells_v e on e.r = a.r and e.c = a.c + 1),
  g_v as (select r, c, z,
      case when c = 0 then coalesce(ez, m) - z when c = 127 then z - coalesce(wz, m) else (coalesce(ez, m) - coalesce(wz, m)) / 2 end gx,
      case when r = 0 then coalesce(down, m) - z when r = mr then z - coalesce(up, m) else (coalesce(down, m) - coalesce(up, m)) / 2 end gy from w_v)"""


@query("slope", sql("cells_v", ctes=EDGE, body="select r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) slope from g_v"))
def slope(d: Data):
    return rounded(stencil.slope(d.layer(), d.grid), 5)


@query("slope_percent", sql("cells_v", ctes=EDGE, body="select r, c, round(sqrt(gx * gx + gy * gy) * 100, 4) slope from g_v"))
def slope_percent(d: Data):
    return rounded(stencil.slope(d.layer(), d.grid, "PERCENT"), 4)


@query(
    "hillshade",
    sql(
        "cells_v",
        ctes=EDGE,
        body="""select r, c, round(255 * greatest(0, least(1, cos(radians(45)) * cos(sl) + sin(radians(45)) * sin(sl) * cos(radians(135) - atan2(-gx, gy)))), 4) + 0.0 shade
        from (select *, atan(sqrt(gx * gx + gy * gy)) sl from g_v)""",
    ),
)
def hillshade(d: Data):
    return rounded(stencil.hillshade(d.layer(), d.grid), 4)


def disc_sql(w: int) -> str:
    return f"(select i, j from range(-{w}, {w + 1}) a(i), range(-{w}, {w + 1}) b(j))"


@query(
    "focal_fraction",
    sql(
        "cells_v",
        ctes=f"v_v as (select r, c, z > 50 p from cells_v where mu < 25), o_v as {disc_sql(2)}",
        body="""select v.r + i r, v.c + j c, round(sum(case when p then 1 else 0 end) / count(*), 6) fraction from v_v v, o_v
          where v.r + i between 0 and (select max(r) from cells_v) and v.c + j between 0 and 127 group by 1, 2""",
    ),
)
def focal(d: Data):
    valid = d.cells.filter("mu < 25").select("r", "c", (F.col("z") > 50).alias("present"))
    return rounded(stencil.focal_fraction(valid, d.grid, 2))


@query(
    "focal_fraction_wide",
    sql(
        "cells_v",
        ctes=f"v_v as (select r, c, z > 50 p from cells_v where mu < 25), o_v as {disc_sql(15)}",
        body="""select v.r + i r, v.c + j c, round(sum(case when p then 1 else 0 end) / count(*), 9) fraction from v_v v, o_v
          where v.r + i between 0 and (select max(r) from cells_v) and v.c + j between 0 and 127 group by 1, 2""",
    ),
)
def focal_wide(d: Data):
    valid = d.cells.filter("mu < 25").select("r", "c", (F.col("z") > 50).alias("present"))
    return rounded(stencil.focal_fraction(valid, d.grid, 15), 9)


@query(
    "within_radius",
    sql(
        "cells_v",
        ctes=f"o_v as {disc_sql(3)}",
        body="""select distinct s.r + i r, s.c + j c from cells_v s, o_v where z > 97 and i * i * 4 + j * j <= 9
          and s.r + i between 0 and (select max(r) from cells_v) and s.c + j between 0 and 127""",
    ),
)
def within(d: Data):
    g = Grid(d.grid.nrows, 128, dx=1.0, dy=2.0)
    return stencil.within_radius(d.cells.filter("z > 97"), g, 3.0)


@query(
    "within_large_radius",
    sql(
        "cells_v",
        ctes=f"o_v as {disc_sql(8)}, g_v as (select r, c from range(0, (select max(r) + 1 from cells_v)) a(r), range(0, 128) b(c))",
        body="""select distinct cast(s.r + i as int) r, cast(s.c + j as int) c from cells_v s, o_v where z > 99.4 and i * i + j * j <= 64
          and s.r + i between 0 and (select max(r) from cells_v) and s.c + j between 0 and 127""",
    ),
)
def within_large(d: Data):
    return stencil.within_radius(d.cells.filter("z > 99.4"), d.grid, 8.0)


@query(
    "nearest_source",
    sql(
        "cells_v",
        ctes="""s_v as (select r, c, z from cells_v where z > 98),
          p_v as (select t.r, t.c, min(struct_pack(d2 := (t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c), sr := s.r, sc := s.c, v := s.z)) m from cells_v t, s_v s group by t.r, t.c)""",
        body="select r, c, m.sr src_r, m.sc src_c, round(sqrt(m.d2), 6) dist, round(m.v, 6) v from p_v",
    ),
)
def nearest_query(d: Data):
    return rounded(nearest.nearest_source(d.layer(), d.layer().filter("v > 98"), d.grid))


KNN_SQL = """s_v as (select r, c, z from cells_v where z > 95),
  p_v as (select t.r, t.c, unnest(min(struct_pack(d2 := (t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c), sr := s.r, sc := s.c, v := s.z), 12)) m
    from cells_v t, s_v s group by t.r, t.c)"""


@query(
    "nearest_k",
    sql(
        "cells_v",
        ctes=KNN_SQL,
        body="""select r, c, cast(row_number() over (partition by r, c order by m.d2, m.sr, m.sc) as int) rank, round(sqrt(m.d2), 6) d, round(m.v, 6) v,
          m.sr src_r, m.sc src_c from p_v""",
    ),
)
def nearest_k_query(d: Data):
    return rounded(knn.nearest_k(d.layer(), d.layer().filter("v > 95"), d.grid))


@query(
    "idw",
    sql(
        "cells_v",
        ctes=KNN_SQL,
        body="select r, c, round(sum(m.v / power(greatest(sqrt(m.d2), 1e-12), 2)) / sum(1 / power(greatest(sqrt(m.d2), 1e-12), 2)), 5) v from p_v group by r, c",
    ),
)
def idw_query(d: Data):
    return rounded(knn.idw(d.layer(), d.layer().filter("v > 95"), d.grid), 5)


@query(
    "kriging_two_neighbours",
    sql(
        "cells_v",
        ctes="""s_v as (select r, c, z from cells_v where z > 95),
  p_v as (select t.r, t.c, min(struct_pack(d2 := (t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c), sr := s.r, sc := s.c, v := s.z), 2) m
    from cells_v t, s_v s group by t.r, t.c),
  h_v as (select r, c, m[1].v v1, m[2].v v2, sqrt(m[1].d2) h1, sqrt(m[2].d2) h2,
    sqrt((m[1].sr - m[2].sr) * (m[1].sr - m[2].sr) + (m[1].sc - m[2].sc) * (m[1].sc - m[2].sc)) h3 from p_v),
  g_v as (select *, case when h1 = 0 then 0 else 0.5 + 2 * case when h1 > 40 then 1 else 1.5 * h1 / 40 - 0.5 * power(h1 / 40, 3) end end g1,
    case when h2 = 0 then 0 else 0.5 + 2 * case when h2 > 40 then 1 else 1.5 * h2 / 40 - 0.5 * power(h2 / 40, 3) end end g2,
    0.5 + 2 * case when h3 > 40 then 1 else 1.5 * h3 / 40 - 0.5 * power(h3 / 40, 3) end g3 from h_v),
  w_v as (select *, 0.5 + (g2 - g1) / (2 * g3) w from g_v)""",
        body="""select r, c, round(w * v1 + (1 - w) * v2, 3) v, round(w * g1 + (1 - w) * g2 + g1 - g3 * (1 - w), 3) variance from w_v""",
    ),
)
def kriging_two_query(d: Data):
    """A fixed spherical model and two neighbours, where the weights have a closed form."""
    return rounded(knn.kriging(d.layer(), d.layer().filter("v > 95"), d.grid, n_closest=2, parameters=(2.0, 40.0, 0.5)), 3)


@query("kriging")
def kriging_query(d: Data):
    return rounded(knn.kriging(d.layer(), d.layer().filter("v > 95"), d.grid), 5)


@query(
    "thin_points",
    sql(
        "cells_v",
        body="""select r, c, round(z, 6) v, c + 0.5 x, -(r + 0.5) y from (select *, row_number() over (order by r, c) - 1 i from cells_v where z > 50) where i % 3 = 0""",
    ),
)
def thin_points(d: Data):
    return rounded(order.cell_points(d.layer().filter("v > 50"), d.grid, 3))


@query(
    "corners",
    sql(
        "cells_v",
        ctes="k_v as (select r, c, z from cells_v union all select r, c - 1, null from cells_v union all select r - 1, c, null from cells_v union all select r - 1, c - 1, null from cells_v), u_v as (select distinct r, c from k_v)",
        body="""select u.r, u.c, round(a.z, 6) ul, round(b.z, 6) ur, round(d.z, 6) ll, round(e.z, 6) lr from u_v u left join cells_v a on a.r = u.r and a.c = u.c
          left join cells_v b on b.r = u.r and b.c = u.c + 1 left join cells_v d on d.r = u.r + 1 and d.c = u.c left join cells_v e on e.r = u.r + 1 and e.c = u.c + 1""",
    ),
)
def corners_query(d: Data):
    return rounded(volume.corners(d.layer()))


def tri_sql(cells: str) -> str:
    """CTE ``t_v``: triangles with their closed-form volumes above and below zero."""

    def above(a: str, b: str, c: str) -> tuple[str, str]:
        # sorted heights: low <= mid <= high
        low, high = f"least({a},{b},{c})", f"greatest({a},{b},{c})"
        mid = f"({a}+{b}+{c}-least({a},{b},{c})-greatest({a},{b},{c}))"
        n = f"(case when {a}>0 then 1 else 0 end + case when {b}>0 then 1 else 0 end + case when {c}>0 then 1 else 0 end)"
        vol = f"""case {n} when 3 then ({a}+{b}+{c})/6.0 when 1 then 0.5*({high}/({high}-{mid}))*({high}/({high}-{low}))*{high}/3.0
          when 2 then ({a}+{b}+{c})/6.0 - 0.5*({low}/({low}-{mid}))*({low}/({low}-{high}))*{low}/3.0 else 0 end"""
        share = f"""case {n} when 3 then 1.0 when 1 then ({high}/({high}-{mid}))*({high}/({high}-{low})) when 2 then 1 - ({low}/({low}-{mid}))*({low}/({low}-{high})) else 0 end"""
        return vol, share

    va, fa = above("a", "b", "d")
    vb, fb = above("(-a)", "(-b)", "(-d)")
    return f"""
      q_v as (select a.v ul, b.v ur, l.v ll, e.v lr from (select r, c from {cells} union select r, c - 1 from {cells} union select r - 1, c from {cells} union select r - 1, c - 1 from {cells}) u
        left join {cells} a on a.r = u.r and a.c = u.c left join {cells} b on b.r = u.r and b.c = u.c + 1
        left join {cells} l on l.r = u.r + 1 and l.c = u.c left join {cells} e on e.r = u.r + 1 and e.c = u.c + 1),
      p_v as (select ul a, ur b, ll d from q_v union all select lr, ll, ur from q_v),
      t_v as (select {va} va, {fa} fa, {vb} vb, {fb} fb, 0.5 * sqrt(1 + (b-a)*(b-a) + (d-a)*(d-a)) dr from p_v where a is not null and b is not null and d is not null)"""


@query(
    "surface_volume",
    sql("cells_v", ctes="x_v as (select r, c, z - 40 v from cells_v)," + tri_sql("x_v"), body="select round(sum(va), 2) volume, round(sum(fa) / 2, 2) area_2d, round(sum(fa * dr), 2) area_3d from t_v"),
)
def surface_volume_query(d: Data):
    return rounded(volume.surface_volume(d.layer(), d.grid, 40.0), 2)


@query(
    "volume_assessment",
    sql(
        "cells_v",
        ctes="x_v as (select r, c, case when abs((k7 - 3) / 2.0) < 0.99 then 0.0 else (k7 - 3) / 2.0 end v from cells_v)," + tri_sql("x_v"),
        body="""select round(sum(va) / 27, 3) fill_volume, round(sum(vb) / 27, 3) excavation_volume, round((sum(va) - sum(vb)) / 27, 3) + 0.0 net_volume, round(sum(fa) / 2, 3) fill_area,
          round(sum(fb) / 2, 3) excavation_area, round(sum(fa * dr), 3) fill_area_3d, round(sum(fb * dr), 3) excavation_area_3d from t_v""",
    ),
)
def volume_query(d: Data):
    cells = d.cells
    old = cells.select("r", "c", F.col("z").alias("v"))
    new = cells.select("r", "c", (F.col("z") + (F.col("k7") - 3) / 2.0).alias("v"))
    return rounded(terrain.volume_assessment(terrain.difference(old, new, d.grid), d.grid), 3)


@query("combine_layers", sql("cells_v", "hydraulics_v", body="select q, r, c, round(z + h, 6) v from hydraulics_v join cells_v using (r, c)"))
def combine(d: Data):
    joined = d.hydraulics.join(d.cells, ["r", "c"])
    return rounded(joined.select("q", "r", "c", (F.col("z") + F.col("h")).alias("v")))



def fine_grid(d: Data) -> Grid:
    return Grid(d.grid.nrows, 128, 3.0, 3.0, 10.0, 500.0)


def coarse_grid(d: Data) -> Grid:
    g = d.grid
    return Grid(-(-g.nrows * 3 // 5), 77, 5.0, 5.0, 10.7, 499.1)


@query(
    "align_nearest",
    sql(
        "cells_v",
        ctes="n_v as (select max(r) + 1 n from cells_v), t_v as (select r, c from range(0, (select cast(ceil(n * 3 / 5.0) as int) from n_v)) a(r), range(0, 77) b(c))",
        body="""select cast(t.r as int) r, cast(t.c as int) c, round(z, 6) v from t_v t join cells_v s on s.c = floor((10.7 + (t.c + 0.5) * 5 - 10) / 3) and s.r = floor((500 - (499.1 - (t.r + 0.5) * 5)) / 3)""",
    ),
)
def align_nearest_query(d: Data):
    return rounded(align.align_nearest(d.layer(), fine_grid(d), coarse_grid(d)))


@query(
    "align_bilinear",
    sql(
        "cells_v",
        ctes="""n_v as (select max(r) + 1 n from cells_v), t_v as (select r, c, (10.7 + (c + 0.5) * 5 - 10) / 3 - 0.5 px, (500 - (499.1 - (r + 0.5) * 5)) / 3 - 0.5 py
            from range(0, (select cast(ceil(n * 3 / 5.0) as int) from n_v)) a(r), range(0, 77) b(c)),
          o_v as (select i, j from range(0, 2) a(i), range(0, 2) b(j))""",
        body="""select cast(t.r as int) r, cast(t.c as int) c, round(sum(w * z) / sum(w), 9) v from (
          select t.r, t.c, s.z, (1 - abs(px - s.c)) * (1 - abs(py - s.r)) w from t_v t, o_v join cells_v s on s.c = floor(px) + j and s.r = floor(py) + i
          where s.mu < 20 and px >= -0.5 and py >= -0.5 and px < 127.5 and py < (select n from n_v) - 0.5) t where w > 0 group by t.r, t.c""",
    ),
)
def align_bilinear_query(d: Data):
    cells = d.cells.filter("mu < 20").select("r", "c", F.col("z").alias("v"))
    return rounded(align.align_bilinear(cells, fine_grid(d), coarse_grid(d)), 9)


@query(
    "resample_mean",
    sql(
        "cells_v",
        ctes="n_v as (select max(r) + 1 n from cells_v), m_v as (select n, cast(floor(n / 2.0) as int) m from n_v)",
        body="select cast(floor((r + 0.5) * m / n) as int) r, cast(floor(c / 2) as int) c, round(avg(z), 9) v from cells_v, m_v group by 1, 2",
    ),
)
def resample_query(d: Data):
    return rounded(align.resample(d.layer(), d.grid, 2.0, "mean")[0], 9)


@query(
    "resample_bilinear",
    sql(
        "cells_v",
        ctes="""n_v as (select max(r) + 1 n, cast(floor((max(r) + 1) / 2.0) as int) m from cells_v),
          t_v as (select r, c, (c + 0.5) * 2 - 0.5 px, (r + 0.5) * (n / m) - 0.5 py, n from n_v, range(0, (select m from n_v)) a(r), range(0, 64) b(c)),
          o_v as (select i, j from range(0, 2) a(i), range(0, 2) b(j))""",
        body="""select cast(r as int) r, cast(c as int) c, round(sum(w * z) / sum(w), 9) v from (
          select t.r, t.c, s.z, (1 - abs(px - s.c)) * (1 - abs(py - s.r)) w from t_v t, o_v join cells_v s on s.c = floor(px) + j and s.r = floor(py) + i
          where px >= -0.5 and py >= -0.5 and px < 127.5 and py < n - 0.5) where w > 0 group by 1, 2""",
    ),
)
def resample_bilinear_query(d: Data):
    return rounded(align.resample(d.layer(), d.grid, 2.0)[0], 9)


@query(
    "align_condition",
    sql(
        "cells_v",
        ctes="n_v as (select max(r) + 1 n from cells_v), t_v as (select r, c from range(0, (select cast(ceil(n * 3 / 5.0) as int) from n_v)) a(r), range(0, 77) b(c))",
        body="""select 'dem' layer, 'aligned' status, count(*) cells, round(sum(z), 3) total from t_v t join cells_v s on s.c = floor((10.7 + (t.c + 0.5) * 5 - 10) / 3) and s.r = floor((500 - (499.1 - (t.r + 0.5) * 5)) / 3)
          union all select 'd2w', 'unchanged', count(*), round(sum(d2w), 3) from cells_v""",
    ),
)
def align_condition_query(d: Data):
    cells = d.cells
    parts = F.array(F.struct(F.lit("dem").alias("layer"), F.col("z").alias("v")), F.struct(F.lit("d2w").alias("layer"), F.col("d2w").alias("v")))
    long = cells.select("r", "c", F.explode(parts).alias("s")).select("s.layer", "r", "c", "s.v")
    coarse = coarse_grid(d)
    out = align.align_condition(long, {"dem": fine_grid(d), "d2w": coarse}, coarse)
    return rounded(out.groupBy("layer", "status").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total")), 3)


def zones(d: Data) -> tuple[DataFrame, DataFrame]:
    """One slanted four-sided polygon per customer, over the whole grid."""
    n = d.grid.nrows
    x0, y0 = "cast(c_custkey * 7 % 120 as double) + 0.37", f"-(cast(c_custkey * 11 % {n} as double) + 0.23)"
    text = f"""select poly_id, 0 ring, s.seq, s.x, s.y from (select c_custkey poly_id, explode(array(
        named_struct('seq', 0, 'x', {x0}, 'y', {y0}), named_struct('seq', 1, 'x', {x0} + 4.1, 'y', {y0} - 0.7),
        named_struct('seq', 2, 'x', {x0} + 3.2, 'y', {y0} - 5.3), named_struct('seq', 3, 'x', {x0} - 0.9, 'y', {y0} - 3.9),
        named_struct('seq', 4, 'x', {x0}, 'y', {y0}))) s from {{customer}})"""
    customer = d.table("customer")
    shapes = d.spark.sql(text, customer=customer)
    return shapes, customer.select(F.col("c_custkey").alias("poly_id"), F.col("c_nationkey").alias("gridcode"), F.col("c_custkey").alias("seq"))


ZONES_SQL = """
  b_v as (select c_custkey id, c_nationkey code, (c_custkey * 7 % 120) + 0.37 x, -((c_custkey * 11 % (select max(r) + 1 from cells_v)) + 0.23) y from customer),
  e_v as (select id, code, x x1, y y1, x + 4.1 x2, y - 0.7 y2 from b_v union all select id, code, x + 4.1, y - 0.7, x + 3.2, y - 5.3 from b_v
    union all select id, code, x + 3.2, y - 5.3, x - 0.9, y - 3.9 from b_v union all select id, code, x - 0.9, y - 3.9, x, y from b_v),
  o_v as (select i, j from range(-1, 8) a(i), range(-3, 8) b(j)),
  n_v as (select id, code, cast(floor(-y) + i as int) r, cast(floor(x) + j as int) c from b_v, o_v),
  h_v as (select n.id, n.code, n.r, n.c from n_v n join e_v e on e.id = n.id and -(n.r + 0.5) >= least(y1, y2) and -(n.r + 0.5) < greatest(y1, y2)
      and n.c + 0.5 >= x1 + (-(n.r + 0.5) - y1) * (x2 - x1) / (y2 - y1)
    where n.r between 0 and (select max(r) from cells_v) and n.c between 0 and 127 group by 1, 2, 3, 4 having count(*) % 2 = 1)"""


@query("rasterize", sql("cells_v", ctes=ZONES_SQL, body="select r, c, arg_max(code, id) v from h_v group by r, c"))
def rasterize_query(d: Data):
    return polygons.rasterize(*zones(d), d.grid)


@query(
    "zonal_statistics",
    sql(
        "cells_v",
        ctes=ZONES_SQL,
        body="""select c_custkey zone, count(z) as "count", round(avg(z), 9) mean, round(min(z), 9) min, round(max(z), 9) max, round(sum(z), 7) sum
          from customer left join (h_v join cells_v using (r, c)) on id = c_custkey group by c_custkey""",
    ),
)
def zonal(d: Data):
    shapes, _ = zones(d)
    inside = polygons.polygon_cells(shapes, d.grid).withColumnRenamed("poly_id", "zone")
    every = shapes.select(F.col("poly_id").alias("zone"))
    return rounded(cellstats.zonal_statistics(inside, d.layer(), every), 9, sum=7)


@query(
    "extract_by_mask",
    sql(
        "cells_v",
        ctes=ZONES_SQL + ", far_v as (select * from b_v where x > 40.5 and y < -20.5)",
        body="""select r, c, round(z, 6) v, cast(floor(-(select max(y) from far_v)) as int) row0, cast(floor((select min(x) - 0.9 from far_v)) as int) col0
          from cells_v where (r, c) in (select (r, c) from h_v where id in (select id from far_v))""",
    ),
)
def extract_query(d: Data):
    shapes = zones(d)[0]
    far = shapes.filter("seq = 0 and x > 40.5 and y < -20.5").select("poly_id")
    return rounded(polygons.extract_by_mask(d.layer(), shapes.join(far, "poly_id", "left_semi"), d.grid))


@query(
    "rasterize_filled",
    sql(
        "cells_v",
        ctes=ZONES_SQL + ", bu_v as (select r, c, arg_max(code, id) v from h_v group by r, c), nr_v as (select max(r) + 1 n from cells_v), gr_v as (select cast(i // 128 as int) r, cast(i % 128 as int) c from range(0, (select n * 128 from nr_v)) t(i))",
        body="select r, c, coalesce(v, -1) v from gr_v left join bu_v using (r, c)",
    ),
)
def rasterize_filled(d: Data):
    return polygons.rasterize(*zones(d), d.grid, fill=-1)


@query("rasterize_all_touched")
def all_touched(d: Data):
    return polygons.rasterize(*zones(d), d.grid, all_touched=True)
