"""Domain pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..grid import Grid
from ..operators.stencil import slope as slope_of
from ..plans import duration, habitat, lifespan, preparation, recruitment, terrain
from ..session import scratch_path
from ..sources import layers
from ..sources.lookup import Feature, RecruitmentParameters, default_features, planting_depth_limit
from .q_algebra import FRY_H, FRY_U, G_US, N_US, SUBSTRATE, curve_sql, grain_sql, shear_sql, units_sql, UNITS
from .q_cells import EDGE
from .q_flow import exceed_sql
from .q_sources import MASKS, masks
from .registry import DISCHARGES, FLOODS, FLOODS_SQL, Data, query, rounded, sql

FEATURES = list(default_features().values())
_names = sorted({n for f in FEATURES for n in (*f.mu_avoid, *f.mu_relevant)})
CODES = {name: i for i, name in enumerate(_names)}
LONGEST = max(f.period for f in FLOODS)


# ---- lifespans


def terrain_table(d: Data):
    """Static layers per cell, slope included."""
    slope = slope_of(d.layer(), d.grid, "PERCENT").select("r", "c", (F.col("slope") / 100.0).alias("slope"))
    base = d.cells.select("r", "c", "dmean", "d2w", F.col("z").alias("dem_detrend"), "mu", "scour", "fill")
    return base.join(slope, ["r", "c"])


def lifespans(d: Data, features=None, best: bool = False):
    chosen = [f for f in FEATURES if f.lifespan_mapping] if features is None else features
    return lifespan.lifespan_cells(d.hydraulics, FLOODS, terrain_table(d), chosen, "us", codes=CODES, best=best)


def fail_sql(f: Feature) -> str | None:
    tests = []
    if f.h_max is not None:
        tests.append(f"h > 0 and h >= {f.h_max}")
    if f.u_max is not None:
        tests.append(f"u >= {f.u_max}")
    if f.froude_max is not None:
        tests.append(f"h > 0 and u / sqrt(cast({G_US!r} as double) * h) >= {f.froude_max}")
    if f.tau_cr is not None and f.safety_factor is not None:
        tests.append(f"h > 0 and {grain_sql('h', 'u', f.tau_cr, N_US, f.safety_factor)} >= dmean")
    elif f.tau_cr is not None:
        tests.append(f"theta84 >= {f.tau_cr}")
    return " or ".join(f"({t})" for t in tests) or None


def mask_sql(f: Feature) -> str | None:
    tests = []
    for column, low, high in (("d2w", f.d2w_min, f.d2w_max), ("z", f.det_min, f.det_max), ("dmean", None, f.grain_max), ("slope", f.terrain_slope, None)):
        if low is not None:
            tests.append(f"{column} >= {low}")
        if high is not None:
            tests.append(f"{column} <= {high}")
    change = [f"{n} {'<' if f.inverse_tcd else '>='} {x}" for n, x in (("scour", f.scour_rate), ("fill", f.fill_rate)) if x is not None]
    if change:
        tests.append("(" + (" and " if f.inverse_tcd else " or ").join(change) + ")")
    units = f.mu_relevant if f.mu_method == 1 else f.mu_avoid
    if units:
        tests.append(f"mu {'in' if f.mu_method == 1 else 'not in'} ({', '.join(str(CODES[u]) for u in units)})")
    return " and ".join(tests) or None


def lifespan_sql(features) -> str:
    """CTEs up to ``life_v (r, c, fid, lifespan, design)``."""
    aggregates, results = [], []
    for i, f in enumerate(features):
        fail, mask = fail_sql(f), mask_sql(f)
        at = next((q for _, q, p in DISCHARGES if f.design_frequency is not None and p >= f.design_frequency), None)
        design = "cast(null as double)"
        if f.design_mapping and f.tau_cr is not None and at is not None:
            aggregates.append(f"max(case when q = {at} then {grain_sql('h', 'u', f.tau_cr, N_US, f.safety_factor or 1.0)} * 12 end) d{i}")
            design = f"d{i}"
        if fail:
            aggregates.append(f"min(case when {fail} then period end) l{i}")
        life = f"l{i}" if fail else f"{LONGEST}"
        if mask:
            life = f"case when {mask} then {life} end"
        results.append(f"select r, c, '{f.fid}' fid, cast({life} as double) lifespan, {design} design from wide_v join ter_v using (r, c)")
    return (
        EDGE
        + f""", ter_v as (select cells_v.*, sqrt(gx * gx + gy * gy) slope from cells_v join g_v using (r, c)),
      fl_v as ({FLOODS_SQL}),
      rows_v as (select k.r, k.c, k.dmean, h.q, case when h.h > 0 then h.h end h, h.u, period from cells_v k left join (hydraulics_v h join fl_v using (q)) on h.r = k.r and h.c = k.c),"""
        + shear_sql("rows_v", "dmean * 2.2", G_US, "r, c, dmean, q, h, u, period")
        + f""", wide_v as (select r, c, {', '.join(aggregates)} from shear_v group by r, c),
      all_v as ({' union all '.join(results)}), life_v as (select * from all_v where lifespan is not null)"""
    )


MAPPED = [f for f in FEATURES if f.lifespan_mapping]
LIFE = lifespan_sql(MAPPED)


@query("lifespan_cells", sql("cells_v", "hydraulics_v", ctes=LIFE, body="select r, c, fid, lifespan, round(design, 5) design from life_v"))
def lifespan_cells(d: Data):
    return rounded(lifespans(d), 5)


@query(
    "lifespan_summary",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes=LIFE,
        body="select fid, count(*) * 9.0::double area, min(lifespan) min_lifespan, max(lifespan) max_lifespan, median(lifespan) median_lifespan from life_v group by fid",
    ),
)
def lifespan_summary(d: Data):
    return lifespan.lifespan_summary(lifespans(d), 9.0)


ROCKS = [f for f in FEATURES if f.fid == "rocks"]


@query(
    "earliest_failure",
    sql("cells_v", "hydraulics_v", ctes=lifespan_sql([Feature("k", "k", tau_cr=0.047, safety_factor=1.3, u_max=6.5, h_max=9.0)]), body="select r, c, lifespan from life_v"),
)
def earliest_failure(d: Data):
    f = Feature("k", "k", tau_cr=0.047, safety_factor=1.3, u_max=6.5, h_max=9.0)
    return lifespans(d, [f]).select("r", "c", "lifespan")


@query(
    "design_grain",
    sql("cells_v", "hydraulics_v", ctes=lifespan_sql(ROCKS), body="select r, c, lifespan, round(design, 5) design from life_v where design is not null"),
)
def design_grain(d: Data):
    return rounded(lifespans(d, ROCKS).filter("design IS NOT NULL").drop("fid"), 5)


@query(
    "design_discharges",
    """with g as (select cast(l_suppkey as int) condition, cast(l_shipdate as date) d, max(l_extendedprice) q from lineitem group by 1, 2),
      f as (select condition, cast(row_number() over (partition by condition order by d) as int) pos, cast(year(d) * 1000 + month(d) as double) q, q / 1000 return_period from g),
      t as (select cast(s_suppkey as int) condition, 'f' || s_nationkey fid, 40.0 + s_nationkey target from supplier)
    select t.condition, fid, arg_min(q, pos) q from t join f on f.condition = t.condition and return_period >= target group by 1, 2
    union all select t.condition, fid, null from t where exists (select 1 from f where f.condition = t.condition) and not exists (select 1 from f where f.condition = t.condition and return_period >= target)""",
)
def design_discharges(d: Data):
    from pyspark.sql import Window

    w = Window.partitionBy("condition").orderBy("d")
    floods = d.gauges.withColumnRenamed("gauge", "condition").select(
        "condition", F.row_number().over(w).alias("pos"), (F.year("d") * 1000 + F.month("d")).cast("double").alias("q"), (F.col("q") / 1000).alias("return_period")
    )
    asked = d.table("supplier").select(
        F.col("s_suppkey").cast("int").alias("condition"), F.concat(F.lit("f"), "s_nationkey").alias("fid"), (F.lit(40.0) + F.col("s_nationkey")).alias("design_frequency")
    )
    return lifespan.design_discharges(floods, asked)


BEST = LIFE + ", best_v as (select *, max(lifespan) over (partition by r, c) best from life_v)"


@query("best_features", sql("cells_v", "hydraulics_v", ctes=BEST, body="select r, c, fid, lifespan from best_v where lifespan = best"))
def best_features(d: Data):
    return lifespans(d, best=True).select("r", "c", "fid", "lifespan")


@query(
    "best_summary",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes=BEST,
        body="""select fid, cast(count(case when lifespan = best then 1 end) * 9.0 as double) area, round(count(case when lifespan = best then 1 end) * 100.0 / (select count(*) from (select distinct r, c from life_v)), 6) share,
          max(case when lifespan = best then lifespan end) max_lifespan from best_v group by fid""",
    ),
)
def best_summary(d: Data):
    return rounded(lifespan.best_summary(lifespans(d), 9.0))


# ---- habitat

CHSI = f"ch_v as (select q, r, c, sqrt(({curve_sql('h', FRY_H)}) * ({curve_sql('u', FRY_U)})) chsi from hydraulics_v where h > 0 and u is not null)"
AREA = "ar_v as (select q, cast(count(case when chsi > 0.4 then 1 end) * 9.0 as double) usable_area, coalesce(avg(chsi), 0) mean_chsi from ch_v group by q)"


@query("habitat_suitability", sql("hydraulics_v", ctes=CHSI, body="select q, r, c, round(chsi, 6) chsi from ch_v"))
def suitability(d: Data):
    return rounded(habitat.composite_suitability(d.hydraulics, FRY_H, FRY_U))


@query("usable_area", sql("hydraulics_v", ctes=CHSI + "," + AREA, body="select q, usable_area, round(mean_chsi, 6) mean_chsi from ar_v"))
def usable(d: Data):
    return rounded(habitat.habitat(d.hydraulics, FRY_H, FRY_U, 9.0)[0])


@query(
    "usable_area_weighted",
    sql("hydraulics_v", ctes=CHSI, body="select q, round(sum(case when chsi > 0.4 then chsi else 0 end) * 9, 4) usable_area, round(avg(chsi), 6) mean_chsi from ch_v group by q"),
)
def usable_weighted(d: Data):
    return rounded(habitat.habitat(d.hydraulics, FRY_H, FRY_U, 9.0, weighted=True)[0], 6, usable_area=4)


FRY_FLOW = "ff_v as (select 1 k, d, q from flow_v where month(d) * 100 + day(d) between 201 and 615)"


@query(
    "seasonal_habitat_area",
    sql(
        "hydraulics_v",
        "flow_v",
        ctes=",".join((CHSI, AREA, FRY_FLOW, exceed_sql("ff_v", ["k"], [q for _, q, _ in DISCHARGES]))),
        body="""select round(sum((exceedance - p) / 100 * usable_area), 4) sharea from (select usable_area, exceedance, lag(exceedance, 1, 0) over (order by exceedance, q) p from ar_v join z_v using (q))""",
    ),
)
def seasonal_area(d: Data):
    curve = duration.duration_curve(d.flow, (2, 1), (6, 15))
    exceed = duration.exceedance_at(curve, d.discharges.select("q"))
    return rounded(habitat.habitat(d.hydraulics, FRY_H, FRY_U, 9.0, exceed)[1], 4)


COVER_CURVES = {"substrate": SUBSTRATE, "cobbles": [(0.1, 0.4)], "wood": [(2.0, 0.7)]}
LOW, HIGH = (repr(x * K.length_factor("us")) for x in K.GRAIN_LIMITS_M["cobbles"])
COVER = f"""
  re_v as (select q, r, c, h, u from hydraulics_v where h >= 0.5),
  o1_v as (select i, j from range(-1, 2) a(i), range(-1, 2) b(j)), o2_v as (select i, j from range(-2, 3) a(i), range(-2, 3) b(j) where i * i + j * j <= 4),
  va_v as (select q, r, c, case when dmean >= cast({LOW} as double) and dmean < cast({HIGH} as double) then 1 else 0 end p, dmean, mu from re_v join cells_v using (r, c)),
  fr_v as (select q, r + i r, c + j c, sum(p) / count(*) f from va_v, o1_v group by 1, 2, 3),
  kinds_v as (select q, r, c, {curve_sql('dmean', SUBSTRATE)} cover, 'substrate' kind from va_v
    union all select q, r, c, 0.4, 'cobbles' from fr_v where f > 0.1 and r between 0 and (select max(r) from cells_v) and c between 0 and 127
    union all select distinct q, r + i, c + j, 0.7, 'wood' from va_v, o2_v where mu = 3 and r + i between 0 and (select max(r) from cells_v) and c + j between 0 and 127),
  cov_v as (select q, r, c, max(cover) cover, count(distinct kind) kinds from kinds_v group by 1, 2, 3)"""


def cover(d: Data):
    cells = d.cells
    parts = F.array(F.struct(F.lit("substrate").alias("cover"), F.col("dmean").alias("v")), F.struct(F.lit("wood").alias("cover"), (F.col("mu") == 3).cast("double").alias("v")))
    inputs = cells.select("r", "c", F.explode(parts).alias("s")).select("s.cover", "r", "c", "s.v")
    return habitat.cover_suitability(inputs, COVER_CURVES, d.grid, "us", d.hydraulics.select("q", "r", "c", "h"), 0.5, "fraction")


@query("cover_suitability", sql("cells_v", "hydraulics_v", ctes=COVER, body="select q, r, c, round(cover, 6) cover, kinds from cov_v"))
def cover_query(d: Data):
    return rounded(cover(d))


@query(
    "habitat_with_cover",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes=COVER + f", ch_v as (select q, r, c, cbrt(({curve_sql('h', FRY_H)}) * ({curve_sql('u', FRY_U)}) * cover) chsi from hydraulics_v join cov_v using (q, r, c) where h > 0)",
        body="select q, cast(count(case when chsi > 0.4 then 1 end) * 9.0 as double) usable_area, round(avg(chsi), 6) mean_chsi from ch_v group by q",
    ),
)
def habitat_cover(d: Data):
    return rounded(habitat.habitat(d.hydraulics, FRY_H, FRY_U, 9.0, cover=cover(d))[0])


# ---- preparation


def thalweg_flow(d: Data):
    return d.hydraulics.filter("q = 7000")


NEAREST = """
  pt_v as (select r, c, v from (select *, row_number() over (order by r, c) - 1 i from (select k.r, k.c, {value} v from cells_v k join hydraulics_v h using (r, c) where h.q = 7000 and h.h > 0)) where i % 2 = 0),
  nn_v as (select t.r, t.c, min(struct_pack(d2 := (t.r - s.r) * (t.r - s.r) + (t.c - s.c) * (t.c - s.c), sr := s.r, sc := s.c, v := s.v)).v v from {targets} t, pt_v s group by t.r, t.c)"""
EVERY = "ev_v as (select cast(r as int) r, cast(c as int) c from range(0, (select max(r) + 1 from cells_v)) a(r), range(0, 128) b(c)),"


@query(
    "detrended_dem",
    sql("cells_v", "hydraulics_v", ctes=NEAREST.format(value="z", targets="cells_v"), body="select r, c, round(z - v, 6) + 0.0 v from cells_v join nn_v using (r, c)"),
)
def detrended(d: Data):
    return rounded(preparation.detrended_dem(d.layer(), thalweg_flow(d), d.grid, step=2))


@query("water_surface", sql("cells_v", "hydraulics_v", ctes=EVERY + NEAREST.format(value="z + h", targets="ev_v"), body="select r, c, round(v, 6) v from nn_v"))
def water(d: Data):
    return rounded(preparation.water_surface(d.layer(), thalweg_flow(d), d.grid, step=2))


# Nearest source per column first, then the best of the 128 columns.
COLUMNS = """
  all_v as (select q, h.r, h.c, k.z + h.h v from hydraulics_v h join cells_v k using (r, c) where h.h > 0),
  pos_v as (select q, e.r, e.c, a.r sr, a.v from (select distinct q from hydraulics_v) cross join ev_v e left join all_v a using (q, r, c)),
  col_v as (select q, r, c, last_value(case when sr is not null then struct_pack(sr := sr, v := v) end ignore nulls) over w up,
    first_value(case when sr is not null then struct_pack(sr := sr, v := v) end ignore nulls) over (partition by q, c order by r rows between current row and unbounded following) dn
    from pos_v window w as (partition by q, c order by r rows between unbounded preceding and current row)),
  one_v as (select q, r, c, case when dn is null or r - up.sr <= dn.sr - r then up else dn end s from col_v where up is not null or dn is not null),
  win_v as (select t.q, t.r, t.c, min(struct_pack(d2 := (t.r - o.s.sr) * (t.r - o.s.sr) + (t.c - o.c) * (t.c - o.c), sr := o.s.sr, sc := o.c, v := o.s.v)).v v
    from one_v o join pos_v t on t.q = o.q and t.r = o.r group by 1, 2, 3)"""


@query("water_surfaces_all_discharges", sql("cells_v", "hydraulics_v", ctes=EVERY + COLUMNS, body="select q, r, c, round(v, 6) v from win_v"))
def waters(d: Data):
    return rounded(preparation.water_surface(d.layer(), d.hydraulics, d.grid, keys=["q"]))


@query(
    "extended_depth",
    sql("cells_v", "hydraulics_v", ctes=EVERY + NEAREST.format(value="z + h", targets="ev_v"), body="select r, c, round(v - z, 6) v from nn_v join cells_v using (r, c) where v - z > 0"),
)
def extended(d: Data):
    return rounded(preparation.extended_depth(d.layer(), preparation.water_surface(d.layer(), thalweg_flow(d), d.grid, step=2)))


@query(
    "depth_to_water",
    sql("cells_v", "hydraulics_v", ctes=EVERY + NEAREST.format(value="z + h", targets="ev_v"), body="select r, c, round(z - v, 6) + 0.0 v from nn_v join cells_v using (r, c)"),
)
def to_water(d: Data):
    return rounded(preparation.depth_to_water(d.layer(), preparation.water_surface(d.layer(), thalweg_flow(d), d.grid, step=2)))


@query("product_units", sql("hydraulics_v", body=f"select * from (select r, c, cast({units_sql('h', 'u')} as int) mu from hydraulics_v where q = 2000) where mu is not null"))
def product(d: Data):
    return preparation.build_product("mu", d.layer(), d.hydraulics.select("q", "r", "c", "h", "u"), d.grid, 2000.0, units=UNITS)["mu"]


SHEAR = "j_v as (select h.*, dmean from hydraulics_v h join cells_v using (r, c))," + shear_sql("j_v", "dmean * 2.2", G_US, "q, r, c")


@query(
    "regime_summary",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes=SHEAR,
        body="""select q, (select count(*) from cells_v) - count(case when regime > 0 then 1 end) invalid, count(case when regime = 1 then 1 end) "Rickenmann-Recking",
          count(case when regime = 2 then 1 end) blended, count(case when regime = 3 then 1 end) "Keulegan-Einstein" from shear_v group by q""",
    ),
)
def regimes(d: Data):
    shear = preparation.bed_shear_stress(d.hydraulics, d.layer("dmean"))
    return preparation.regime_summary(shear, d.table("orders").count())


@query(
    "shear_layers",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes=SHEAR,
        body="""select q, r, c, 'ts' layer, round(theta84, 6) v from shear_v where regime > 0 union all select q, r, c, 'tb', round(ustar2, 6) from shear_v where regime > 0
          union all select q, r, c, 'hks', round(h_over_ks, 6) from shear_v where regime > 0 union all select q, r, c, 'regime', regime from shear_v where regime > 0""",
    ),
)
def shear_layers(d: Data):
    return rounded(layers.shear_layers(preparation.bed_shear_stress(d.hydraulics, d.layer("dmean"))))


@query("stored_shear_layers", sql("cells_v", "hydraulics_v", ctes=SHEAR, body="select q, r, c, round(theta84, 6) v from shear_v where regime > 0"))
def stored_shear_layers(d: Data):
    """Shear layers written by discharge and quantity; one quantity is read back."""
    path = scratch_path(d.spark)
    layers.write_layers(layers.shear_layers(preparation.bed_shear_stress(d.hydraulics, d.layer("dmean"))), path, ["q", "layer"])
    back = layers.read_layers(d.spark, path, ["ts"])
    return rounded(back.select(F.col("q").cast("double").alias("q"), "r", "c", "v"))


@query(
    "standalone_shear",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes="""dm_v as (select t.r, t.c, s.dmean from cells_v t join cells_v s on s.r = floor((t.r + 0.5) / 1.5) and s.c = floor((t.c + 0.5) / 1.5)),
          j_v as (select h.r, h.c, h.h, h.u, dm_v.dmean from hydraulics_v h left join dm_v using (r, c) where q = 3000),"""
        + shear_sql("j_v", "dmean", K.GRAVITY_SI, "r, c"),
        body="select r, c, round(ustar2, 6) ustar2, round(theta84, 6) theta84, round(h_over_ks, 6) h_over_ks, regime from shear_v",
    ),
)
def standalone(d: Data):
    flow = d.hydraulics.filter("q = 3000")
    g = d.grid
    coarse = Grid(g.nrows, 128, 1.5, 1.5)
    out = preparation.standalone_shear(
        flow.select("r", "c", F.col("u").alias("v")), g, flow.select("r", "c", F.col("h").alias("v")), g, d.layer("dmean"), coarse, "d84"
    )
    return rounded(out)


# ---- terrain works

TERRA = MASKS + """,
  pl_v as (select r, c, min(struct_pack(o := case layer when 'lf_g' then 0 when 'best_f3' then 1 else 2 end, f := regexp_replace(layer, '^(best_|lf_|ds_)', ''))).f fid from m_v
    where v > 0 and layer in ('lf_g', 'best_f3', 'best_f1') group by 1, 2),
  tc_v as (select k.r, k.c, k.z, k.d2w, fid, case when fid is not null and d2w > 7 then d2w - 7.0 else 0 end cut from cells_v k left join pl_v using (r, c))"""


def terraformed(d: Data):
    ground = d.cells.select("r", "c", F.col("z").alias("dem"), "d2w")
    return terrain.lowered_cells(ground, layers.action_masks(masks(d), ["g", "f3", "f1"]), planting_depth_limit())


@query(
    "terraforming",
    sql("cells_v", ctes=TERRA, body="select r, c, round(z, 6) dem, round(d2w, 6) d2w, case when cut > 0 then fid end fid, round(cut, 6) cut, round(z - cut, 6) + 0.0 dem_new, round(d2w - cut, 6) d2w_new from tc_v"),
)
def terraforming(d: Data):
    return rounded(terraformed(d))


@query(
    "terraforming_summary",
    sql(
        "cells_v",
        ctes=TERRA,
        body="""select f.fid, count(cut) cells, count(cut) * 9.0::double area, round(coalesce(sum(cut), 0) * 9, 3) volume, round(coalesce(max(cut), 0), 6) max_cut
          from (values ('g'), ('f3'), ('f1')) f(fid) left join (select * from tc_v where cut > 0) t on t.fid = f.fid group by 1""",
    ),
)
def terraforming_summary(d: Data):
    every = d.values([("g",), ("f3",), ("f1",)], "fid string")
    return rounded(terrain.terraforming_summary(terraformed(d), 9.0, every), 6, volume=3)


@query(
    "terraforming_total",
    sql("cells_v", ctes=TERRA, body="select count(*) modified_cells, count(*) * 9.0::double modified_area, round(sum(cut) * 9, 3) cut_volume, round(max(cut), 6) max_cut from tc_v where cut > 0"),
)
def terraforming_total(d: Data):
    return rounded(terrain.terraforming_total(terraformed(d), 9.0), 6, cut_volume=3)


# ---- recruitment

YEAR = 1996
LEVEL = "5 + least(greatest({q}, 1000), 7000) / 100"
RECRUIT = f"""
  pk_v as (select max(case when d >= date '1995-05-02' and d < date '1996-05-02' then q end) prep, max(case when d > date '1996-06-20' and d <= date '1996-09-15' then q end) scp,
    min(case when d between date '1996-05-02' and date '1996-06-20' then q end) lo, max(case when d between date '1996-05-02' and date '1996-06-20' then q end) hi from flow_v),
  crop_v as (select r, c, z from cells_v, pk_v where z <= {LEVEL.format(q='hi')} and z >= {LEVEL.format(q='lo')} and mu <> 5),
  dy_v as (select d, {LEVEL.format(q='q')} lv, row_number() over (order by d) - 1 i, d >= date '1996-05-02' s, d <= date '1996-06-20' e from flow_v where d between date '1996-04-29' and date '1996-09-15'),
  dx_v as (select *, lag(lv, 3) over (order by i) lv3, coalesce(sum(case when s then 1 else 0 end) over (order by i rows between unbounded preceding and 1 preceding), 0) el from dy_v),
  cd_v as (select r, c, z, i, s, e, el, (lv3 - lv) / 3 * 30.48 dr, not (lv > z) dry from crop_v, dx_v),
  w1_v as (select *, lag(dry, 1, true) over (partition by r, c order by i) was, max(case when dry then i end) over (partition by r, c order by i) ld from cd_v),
  rs_v as (select r, c, max(case when dry and not was and e then i end) ri from w1_v group by 1, 2),
  w2_v as (select w.*, coalesce(ri, -1) ri from w1_v w join rs_v using (r, c)),
  ct_v as (select r, c, max(ri) ri, sum(case when dry and i >= ri and i >= 3 and s and dr >= 5 then 1 else 0 end) le, sum(case when dry and i >= ri and i >= 3 and s and dr >= 2.5 and dr < 5 then 1 else 0 end) st,
    max(case when i >= ri then i - coalesce(ld, -1) else 0 end) longest from w2_v group by 1, 2),
  tr_v as (select t.*, case when ri < 0 then tot else greatest(tot - el, 1) end tracked from ct_v t left join dx_v on dx_v.i = ri, (select count(case when s then 1 end) tot from dx_v)),
  mo_v as (select r, c, (le / tracked * 100.0 * 3 + st / tracked * 100.0) / 3 mortality, cast(longest as int) longest from tr_v),
  j_v as (select h.*, dmean from hydraulics_v h join cells_v using (r, c)), {shear_sql("j_v", "dmean * 2.2", G_US, "q, r, c")},
  qm_v as (select r, c, min(case when theta84 >= 0.047 then q end) qf, min(case when theta84 >= 0.03 then q end) qp from shear_v group by 1, 2),
  sc_v as (select r, c, case when k7 = 6 then 1.0 when qf <= prep then 1.0 when qp <= prep then 0.5 else 0.0 end bed, case when mortality > 30 then 0.0 when mortality >= 20 then 0.5 else 1.0 end desiccation,
    case when longest > 28 then 0.0 when longest >= 14 then 0.5 else 1.0 end inundation, case when qf <= scp then 0.0 when qp <= scp then 0.5 else 1.0 end scour, mortality, longest
    from mo_v join cells_v using (r, c) left join qm_v using (r, c), pk_v)"""


def recruit(d: Data):
    cells, flow = d.cells, d.flow
    listed = F.array(*[F.lit(q) for _, q, _ in DISCHARGES])
    wle = cells.select("r", "c", F.explode(listed).alias("q")).withColumn("wle", F.lit(5.0) + F.col("q") / 100.0)
    return recruitment.recruitment(
        d.layer(), wle, d.hydraulics, d.layer("dmean"), flow, 9.0, YEAR, RecruitmentParameters(), "us", cells.filter("mu = 5"), cells.filter("k7 = 6"),
        [q for _, q, _ in DISCHARGES],
    )


@query(
    "mobilising_discharge",
    sql("cells_v", "hydraulics_v", ctes=SHEAR, body="select r, c, min(case when theta84 >= 0.047 then q end) q_full, min(case when theta84 >= 0.03 then q end) q_partial from shear_v group by r, c"),
)
def mobilising(d: Data):
    return recruitment.mobilising_discharge(d.hydraulics, d.layer("dmean"), {"q_full": 0.047, "q_partial": 0.03})


@query(
    "recruitment",
    sql(
        "cells_v",
        "hydraulics_v",
        "flow_v",
        ctes=RECRUIT,
        body="select r, c, cast(bed as double) bed, cast(desiccation as double) desiccation, cast(inundation as double) inundation, cast(scour as double) scour, round(mortality, 6) mortality, longest, cast(bed * desiccation * inundation * scour as double) potential from sc_v",
    ),
)
def recruitment_query(d: Data):
    return rounded(recruit(d).cells)


@query(
    "recruitment_summary",
    sql(
        "cells_v",
        "hydraulics_v",
        "flow_v",
        ctes=RECRUIT + ", po_v as (select *, bed * desiccation * inundation * scour p from sc_v)",
        body="""select count(*) * 9.0::double crop_area, count(case when p >= 1 then 1 end) * 9.0::double recruitment_area, count(case when p >= 0.125 and p < 1 then 1 end) * 9.0::double partial_area,
          count(case when bed >= 1 then 1 end) * 9.0::double bed_area, count(case when desiccation >= 1 then 1 end) * 9.0::double desiccation_area, count(case when inundation >= 1 then 1 end) * 9.0::double inundation_area,
          count(case when scour >= 1 then 1 end) * 9.0::double scour_area from po_v""",
    ),
)
def recruitment_summary(d: Data):
    return recruit(d).summary


#: The same walk for two conditions, three gauges and two years at once.
SEASONS = f"""
  ga_v as (select cast(l_suppkey % 3 as int) gauge, cast(l_shipdate as date) d, 1000 + cast(sum(cast(round(l_extendedprice * 100) as bigint)) % 768000 as double) / 128 q
    from lineitem group by cast(l_suppkey % 3 as int), cast(l_shipdate as date)),
  gr_v as (select cast(ord % 2 as int) condition, r, c, z, dmean from cells_v where mu <> 5),
  gy_v as (select gauge, d, q, y, make_date(y, 5, 2) s0, make_date(y, 6, 20) s1, make_date(y, 9, 15) b0, make_date(y - 1, 5, 2) p0 from ga_v, (values (1995), (1996)) t(y)),
  pk_v as (select gauge, y, max(case when d >= p0 and d < s0 then q end) prep, max(case when d > s1 and d <= b0 then q end) scp,
    min(case when d between s0 and s1 then q end) lo, max(case when d between s0 and s1 then q end) hi from gy_v group by gauge, y),
  crop_v as (select condition, gauge, y, r, c, z from gr_v, pk_v where z <= condition + {LEVEL.format(q='hi')} and z >= condition + {LEVEL.format(q='lo')}),
  dy_v as (select gauge, y, {LEVEL.format(q='q')} lv, row_number() over (partition by gauge, y order by d) - 1 i, d >= s0 s, d <= s1 e from gy_v where d between s0 - 3 and b0),
  dx_v as (select *, lag(lv, 3) over (partition by gauge, y order by i) lv3, coalesce(sum(case when s then 1 else 0 end) over (partition by gauge, y order by i rows between unbounded preceding and 1 preceding), 0) el from dy_v),
  cd_v as (select condition, gauge, y, r, c, i, s, e, (lv3 - lv) / 3 * 30.48 dr, not (lv + condition > z) dry from crop_v join dx_v using (gauge, y)),
  w1_v as (select *, lag(dry, 1, true) over (partition by gauge, y, r, c order by i) was, max(case when dry then i end) over (partition by gauge, y, r, c order by i) ld from cd_v),
  w2_v as (select *, coalesce(max(case when dry and not was and e then i end) over (partition by gauge, y, r, c), -1) ri from w1_v),
  ct_v as (select condition, gauge, y, r, c, max(ri) ri, sum(case when dry and i >= ri and i >= 3 and s and dr >= 5 then 1 else 0 end) le, sum(case when dry and i >= ri and i >= 3 and s and dr >= 2.5 and dr < 5 then 1 else 0 end) st,
    max(case when i >= ri then i - coalesce(ld, -1) else 0 end) longest from w2_v group by all),
  to_v as (select gauge, y, count(case when s then 1 end) tot from dx_v group by gauge, y),
  tr_v as (select t.*, case when ri < 0 then tot else greatest(tot - el, 1) end tracked from ct_v t join to_v using (gauge, y) left join dx_v x on x.i = ri and x.gauge = t.gauge and x.y = t.y),
  mo_v as (select *, (le / tracked * 100.0 * 3 + st / tracked * 100.0) / 3 mortality from tr_v),
  j_v as (select h.*, dmean from hydraulics_v h join gr_v using (r, c)), {shear_sql("j_v", "dmean * 2.2", G_US, "q, r, c")},
  qm_v as (select r, c, min(case when theta84 >= 0.047 then q end) qf, min(case when theta84 >= 0.03 then q end) qp from shear_v group by 1, 2)"""


@query(
    "recruitment_all_seasons",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes=SEASONS,
        body="""select condition, gauge, y "year", r, c, cast(case when prep is null then 0 when qf <= prep then 1 when qp <= prep then 0.5 else 0 end as double) bed,
          cast(case when mortality > 30 then 0 when mortality >= 20 then 0.5 else 1 end as double) desiccation,
          cast(case when longest > 28 then 0 when longest >= 14 then 0.5 else 1 end as double) inundation,
          cast(case when scp is null then 1 when qf <= scp then 0 when qp <= scp then 0.5 else 1 end as double) scour, round(mortality, 6) mortality, cast(longest as int) longest,
          bed * desiccation * inundation * scour potential from mo_v join pk_v using (gauge, y) left join qm_v using (r, c)""",
    ),
)
def recruitment_all_seasons(d: Data):
    keyed = d.cells.filter("mu <> 5").withColumn("condition", F.expr("cast(ord % 2 as int)"))
    layer = lambda column: keyed.select("condition", "r", "c", F.col(column).cast("double").alias("v"))
    listed = F.array(*[F.lit(q) for _, q, _ in DISCHARGES])
    wle = keyed.select("condition", "r", "c", F.explode(listed).alias("q")).withColumn("wle", F.lit(5.0) + F.col("condition") + F.col("q") / 100.0)
    hydraulics = d.hydraulics.join(keyed.select("condition", "r", "c"), ["r", "c"])
    gauges = d.table("lineitem").groupBy(F.expr("cast(l_suppkey % 3 as int)").alias("gauge"), F.col("l_shipdate").cast("date").alias("d"))
    flow = gauges.agg(F.expr("1000 + cast(sum(cast(round(l_extendedprice * 100) as bigint)) % 768000 as double) / 128").alias("q"))
    got = recruitment.recruitment(
        layer("z"), wle, hydraulics, layer("dmean"), flow, 9.0, (1995, 1996), keys=["condition"], flow_keys=["gauge"]
    )
    return rounded(got.cells)


@query(
    "crop_band",
    sql(
        "cells_v",
        "hydraulics_v",
        "flow_v",
        ctes=f"b_v as (select {LEVEL.format(q='q')} lv from flow_v order by abs(date_diff('day', date '1996-09-15', d)), d limit 1)",
        body="select r, c, round(z, 6) dem from cells_v, b_v where z - lv between -300 / 30.48 and 450 / 30.48",
    ),
)
def crop_band(d: Data):
    listed = F.array(*[F.lit(q) for _, q, _ in DISCHARGES])
    wle = d.cells.select("r", "c", F.explode(listed).alias("q")).withColumn("wle", F.lit(5.0) + F.col("q") / 100.0)
    p = RecruitmentParameters(band_lower=-300.0, band_upper=450.0)
    return rounded(recruitment.crop_area(d.layer(), wle, d.flow, p, YEAR).drop("year"))


