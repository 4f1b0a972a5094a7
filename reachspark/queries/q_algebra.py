"""Per-cell scalars: one projection each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import algebra, channel, naming, season, shear
from ..plans.preparation import UnitRange, morphological_units
from ..sources.lookup import unit_codes
from .registry import Data, query, rounded, sql

FRY_H = [(0.0, 0.0), (0.5, 0.4), (1.5, 1.0), (3.0, 1.0), (6.0, 0.0)]
FRY_U = [(0.0, 1.0), (1.0, 1.0), (3.0, 0.3), (5.0, 0.0)]
SUBSTRATE = [(0.0, 0.0), (0.05, 0.6), (0.15, 1.0), (0.3, 0.0)]
UNITS = [
    UnitRange("pool", 1, 2, 10, 0, 1),
    UnitRange("riffle", 2, 0, 1, 1, 4),
    UnitRange("run", 3, 1, 3, 1, 4),
    UnitRange("chute", 4, 1, 10, 4, 9),
    UnitRange("glide", 5, 0.5, 3, 0, 1),
    UnitRange("floodplain", 20),
]
N_US, G_US = K.manning("us"), K.gravity("us")


def curve_sql(v: str, points) -> str:
    """The curve as CASE text."""
    points = sorted(points)
    text = f"case when {v} is null then null when {v} < {points[0][0]} then {points[0][1]} "
    for (xa, ya), (xb, yb) in zip(points, points[1:]):
        text += f"when {v} < {xb} then {ya} + ({v} - {xa}) * cast({(yb - ya) / (xb - xa)!r} as double) "
    return text + f"when {v} = {points[-1][0]} then {points[-1][1]} else 0 end"


def grain_sql(h: str, u: str, tau: float, n: float, sf: float = 1.0) -> str:
    k = (K.RELATIVE_GRAIN_DENSITY - 1.0) * tau
    return f"(case when {h} > 0 then power({u} * cast({n!r} as double), 2) / (cast({k!r} as double) * power({h}, 1.0/3)) / cast({sf} as double) end)"


def shear_sql(source: str, d84: str, g: float, keep: str) -> str:
    """CTE ``shear_v``: the closure on the rows of ``source`` (columns h, u and ``d84``)."""
    rr = "4.416 * power(x, 1.904) * power(1 + power(x / 1.283, 1.618), -1.083)"
    t = "greatest(0, least(1, (chi - 7.0) / 13.0))"
    gs = g * (K.RELATIVE_GRAIN_DENSITY - 1.0)
    return f"""
    s1_v as (select *, {d84} as d84 from {source}),
    s2_v as (select *, case when u >= 0 and h > 0 and d84 > 0 then h / d84 end x,
        case when u >= 0 and h > 0 and d84 > 0 then h / (2.0 * d84) end chi from s1_v),
    s3_v as (select *, {rr} rr, case when chi > 7 then 5.75 * log10(12.2 * chi) else {rr} end ll,
        {t} * {t} * (3 - 2 * {t}) w from s2_v),
    s4_v as (select *, case when x is not null then u * u * ((1 - w) / (rr * rr) + w / (ll * ll)) end ustar2 from s3_v),
    shear_v as (select {keep}, ustar2, ustar2 / (cast({gs!r} as double) * d84) theta84, case when ustar2 is not null then chi end h_over_ks,
        cast(case when ustar2 is null then 0 when chi <= 7 then 1 when chi < 20 then 2 else 3 end as int) regime from s4_v)"""


def scalar(name: str, source: str, make, text: str, keep: tuple[str, ...] = ("r", "c"), digits: int | None = 6):
    """Register ``select keep, expression as v from source`` in both languages."""
    kept = ", ".join(keep)
    body = f"round({text}, {digits}) + 0.0" if digits is not None else text
    oracle = sql(source, body=f"select {kept}, {body} as v from {source}")

    @query(name, oracle)
    def run(d: Data):
        v = make()
        v = F.round(v, digits) + F.lit(0.0) if digits is not None else v
        return d.view(source).select(*keep, v.alias("v"))


QRC = ("q", "r", "c")
scalar("con", "cells_v", lambda: algebra.con(F.col("z") > 50, "z"), "case when z > 50 then z end")
scalar("con_else", "cells_v", lambda: algebra.con(F.col("z") > 50, "z", 0.0), "case when z > 50 then z else 0 end")
scalar(
    "is_null",
    "cells_v",
    lambda: algebra.is_null(F.when(F.col("mu") > 20, F.col("z") / 0.5).when(F.col("mu") > 10, F.lit(float("inf")))),
    "not coalesce(case when mu > 20 then true when mu > 10 then false end, false)",
    digits=None,
)
scalar("set_null", "cells_v", lambda: algebra.set_null(F.col("z") > 50, "z"), "case when not (z > 50) then z end")
scalar(
    "reclassify",
    "cells_v",
    lambda: algebra.reclassify("d2w", [2.0, 5.0, 10.0], [1.0, 2.0, 3.0, 4.0]),
    "case when d2w <= 2 then 1 when d2w <= 5 then 2 when d2w <= 10 then 3 else 4 end",
)
scalar(
    "reclassify_left_closed",
    "cells_v",
    lambda: algebra.reclassify("d2w", [2.0, 5.0, 10.0], [1.0, 2.0, 3.0, 4.0], right=False),
    "case when d2w < 2 then 1 when d2w < 5 then 2 when d2w < 10 then 3 else 4 end",
)
scalar("apply_curve", "hydraulics_v", lambda: algebra.apply_curve("h", FRY_H), curve_sql("h", FRY_H), QRC)
scalar("critical_grain", "hydraulics_v", lambda: shear.critical_grain("h", "u", 0.047, N_US, 1.3), grain_sql("h", "u", 0.047, N_US, 1.3), QRC)
scalar("froude", "hydraulics_v", lambda: shear.froude("h", "u", G_US), f"case when h > 0 then u / sqrt(cast({G_US!r} as double) * h) end", QRC)
scalar("d84_of_grain", "cells_v", lambda: shear.d84("dmean"), "dmean * 2.2")
scalar(
    "power_law_ratio",
    "hydraulics_v",
    lambda: shear.power_law_ratio(F.col("h") / 0.5),
    "4.416 * power(h / 0.5, 1.904) * power(1 + power((h / 0.5) / 1.283, 1.618), -1.083)",
    QRC,
)
scalar("log_law_ratio", "hydraulics_v", lambda: shear.log_law_ratio(F.col("h") + 0.5), "5.75 * log10(12.2 * (h + 0.5))", QRC)
scalar(
    "blend_weight",
    "hydraulics_v",
    lambda: shear.blend_weight(F.col("h") * 3.0),
    "power(greatest(0, least(1, (h * 3.0 - 7) / 13.0)), 2) * (3 - 2 * greatest(0, least(1, (h * 3.0 - 7) / 13.0)))",
    QRC,
)
scalar(
    "composite_hsi",
    "hydraulics_v",
    lambda: algebra.composite_hsi("h", algebra.apply_curve("h", FRY_H), algebra.apply_curve("u", FRY_U)),
    f"case when coalesce(h, 0) > 0 then sqrt(({curve_sql('h', FRY_H)}) * ({curve_sql('u', FRY_U)})) end",
    QRC,
)
scalar(
    "composite_hsi_cover",
    "hydraulics_v",
    lambda: algebra.composite_hsi("h", algebra.apply_curve("h", FRY_H), algebra.apply_curve("u", FRY_U), F.lit(0.5)),
    f"case when coalesce(h, 0) > 0 then cbrt(({curve_sql('h', FRY_H)}) * ({curve_sql('u', FRY_U)}) * 0.5) end",
    QRC,
)
scalar("wet_mask", "hydraulics_v", lambda: algebra.wet(F.when(F.col("u") < 6, F.col("h")), 0.9), "coalesce(case when u < 6 then h end, 0) > 0.9", QRC, None)
scalar("range_mask", "cells_v", lambda: algebra.in_range(F.when(F.col("mu") < 25, F.col("d2w")), 1.0, 7.0), "coalesce(case when mu < 25 then d2w end between 1 and 7, false)", digits=None)
scalar("change_mask", "cells_v", lambda: algebra.change_mask("scour", "fill", 3.0, 3.36), "(scour >= 3.0) or (fill >= 3.36)", digits=None)
scalar("change_mask_inverse", "cells_v", lambda: algebra.change_mask("scour", "fill", 3.0, 3.36, True), "(scour < 3.0) and (fill < 3.36)", digits=None)
scalar("unit_mask", "cells_v", lambda: algebra.unit_mask("mu", [3, 4, 9], True), "mu in (3, 4, 9)", digits=None)
scalar(
    "unit_mask_avoid",
    "cells_v",
    lambda: algebra.unit_mask(F.when(F.col("k7") > 0, F.col("mu")), [3, 4, 9], False),
    "not coalesce((case when k7 > 0 then mu end) in (3, 4, 9), false)",
    digits=None,
)
scalar("lower_terrain", "cells_v", lambda: algebra.lowered("z", "d2w", F.col("mu") < 10, 7.0), "case when mu < 10 and d2w > 7 then z - (d2w - 7.0) else z end")
scalar(
    "level_of_detection",
    "cells_v",
    lambda: algebra.level_of_detection((F.col("k7") - 3) / 2.0, 0.99),
    "case when abs((k7 - 3) / 2.0) < 0.99 then 0.0 else (k7 - 3) / 2.0 end",
)
scalar(
    "score_ladder",
    "cells_v",
    lambda: algebra.ladder("d2w", [(">", 15.0, 0.0), (">=", 10.0, 0.5)], 1.0),
    "case when d2w > 15 then 0 when d2w >= 10 then 0.5 else 1 end",
)
FT = K.length_factor("us")
scalar(
    "derived_presence",
    "cells_v",
    lambda: (F.col("dmean") * 10 >= F.lit(0.064 * FT)) & (F.col("dmean") * 10 < F.lit(0.256 * FT)),
    f"dmean * 10 >= cast({0.064 * FT!r} as double) and dmean * 10 < cast({0.256 * FT!r} as double)",
    digits=None,
)
scalar("in_season", "flow_v", lambda: season.in_season("d", (10, 1), (2, 28)), "month(d) * 100 + day(d) >= 1001 or month(d) * 100 + day(d) <= 228", ("d",), None)
scalar("season_dates", "flow_v", lambda: season.date_in(F.year("d"), (5, 2)), "make_date(year(d), 5, 2)", ("d",), None)


@query(
    "extract_rectangle",
    sql("cells_v", body="select r, c, round(z, 6) + 0.0 as v from cells_v where c + 0.5 between 20 and 60 and -(r + 0.5) between -80 and -10"),
)
def extract_rectangle(d: Data):
    g = d.grid
    inside = g.x("c").between(20, 60) & g.y("r").between(-80, -10)
    return rounded(d.layer().filter(inside))


@query(
    "fill_cut_split",
    sql(
        "cells_v",
        body="""select r, c, round(v, 6) + 0.0 v, case when v > 0 then round(v, 6) end fill, case when v < 0 then round(v, 6) end excavation
        from (select r, c, (k7 - 3) / 2.0 v from cells_v)""",
    ),
)
def fill_cut_split(d: Data):
    from ..plans.terrain import fill_and_cut

    return rounded(fill_and_cut(d.cells.select("r", "c", ((F.col("k7") - 3) / 2.0).alias("v"))))


@query(
    "bed_shear",
    sql(
        "cells_v",
        "hydraulics_v",
        ctes="j_v as (select h.*, dmean from hydraulics_v h join cells_v using (r, c)),"
        + shear_sql("j_v", "dmean * 2.2", G_US, "q, r, c"),
        body="select q, r, c, round(ustar2, 6) ustar2, round(theta84, 6) theta84, round(h_over_ks, 6) h_over_ks, regime from shear_v",
    ),
)
def bed_shear(d: Data):
    from ..plans.preparation import bed_shear_stress

    return rounded(bed_shear_stress(d.hydraulics, d.layer("dmean")))


@query(
    "unit_system",
    sql(
        "cells_v",
        body="""select r, c, case when mu % 2 = 0 then 'us' else 'si' end unit, case when mu % 2 = 0 then 'cfs' else 'cms' end q_label,
        case when mu % 2 = 0 then 'sqft' else 'sqm' end area_label, round(z * case when mu % 2 = 0 then 9.81 / 0.3048 else 9.81 end, 8) weight from cells_v""",
    ),
)
def unit_system(d: Data):
    us = F.col("mu") % 2 == 0
    pick = lambda f: F.when(us, F.lit(f("us"))).otherwise(F.lit(f("si")))
    return rounded(
        d.cells.select(
            "r", "c", pick(str).alias("unit"), pick(lambda u: K.UNIT_LABELS[u]["q"]).alias("q_label"),
            pick(lambda u: K.UNIT_LABELS[u]["area"]).alias("area_label"), (F.col("z") * pick(K.gravity)).alias("weight"),
        ),
        8,
    )


def units_sql(h: str, u: str) -> str:
    hits = []
    for m in UNITS:
        if m.h_min is not None:
            low_h, high_h, low_u, high_u = (f"cast({x * FT!r} as double)" for x in (m.h_min, m.h_max, m.u_min, m.u_max))
            hits.append(f"case when {h} > 0 and {h} >= {low_h} and {h} < {high_h} and {u} >= {low_u} and {u} < {high_u} then {m.code} end")
    return f"greatest({', '.join(hits)})"


@query(
    "morphological_units",
    sql("hydraulics_v", body=f"select * from (select q, r, c, cast({units_sql('h * 3', 'u * 3')} as int) mu from hydraulics_v) where mu is not null"),
)
def morphological_units_query(d: Data):
    scaled = d.hydraulics.select("q", "r", "c", (F.col("h") * 3).alias("h"), (F.col("u") * 3).alias("u"))
    return morphological_units(scaled, UNITS, "us", keys=["q"])


@query(
    "unit_codes",
    """select distinct name, code from (
      select lower(p_name) name, min(p_size) code from part group by 1
      union all select 'agriplain', min(p_size) from part having count(*) > 0
      union all select 'agricultural plain', min(p_size) from part having count(*) > 0
      union all select 'backswamp', max(p_size) from part having count(*) > 0)""",
)
def unit_codes_query(d: Data):
    part = d.table("part")
    base = part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_size").alias("code"))
    extra = part.agg(F.min("p_size").alias("code")).select(F.lit("Agricultural plain").alias("name"), "code")
    given = part.agg(F.max("p_size").alias("code")).select(F.lit("backswamp").alias("name"), "code")
    return unit_codes(base.unionByName(extra).unionByName(given))


@query(
    "discharge_names",
    sql(
        "catalog_v",
        body=r"""select condition, name, q,
          case when q is null then null when q = floor(q) then printf('%06d', cast(q as bigint)) else replace(printf('%010.3f', q), '.', '_') end token,
          case when q is null then null when q = floor(q) then cast(cast(q as bigint) as varchar) else rtrim(printf('%.4f', q), '0') end label,
          regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '^[a-zA-Z_]+', '') own
        from (select *, try_cast(replace(nullif(regexp_extract(name, '\d+(_\d+)?'), ''), '_', '.') as double) q from catalog_v)""",
    ),
)
def discharge_names(d: Data):
    named = d.view("catalog_v").withColumn("q", naming.discharge_of("name"))
    return named.select(
        "condition", "name", "q", naming.discharge_token("q").alias("token"), naming.discharge_label("q").alias("label"), naming.own_token("name").alias("own")
    )


REACHES = """select p_partkey reach_id, cast(0.02 + (p_partkey % 40) / 400.0 as double) d50, cast(0.002 + (p_partkey % 17) / 1000.0 as double) slope,
  cast(5 + p_size / 2.0 as double) base_width, cast(1.5 + (p_partkey % 5) / 4.0 as double) bank_slope, cast(0.3 + p_size / 40.0 as double) depth from {part}"""


@query(
    "channel_functions",
    f"""with reaches as ({REACHES.format(part='part')}), a as (select *, power(d50, 1.0/6) / 21.1 n, 0.047 * 1.68 * d50 / slope hc from reaches)
    select reach_id, round(n, 6) strickler, round(power(2.75 * d50, 1.0/6) / 26.0, 6) mpm,
      round(power(depth, 1.0/6) / (4.416 * power(depth / (2.2 * d50), 1.904) * power(1 + power(depth / (2.2 * d50) / 1.283, 1.618), -1.083)), 6) rr,
      round(power(depth * (base_width + bank_slope * depth), 5.0/3) * sqrt(slope) / (n * power(base_width + 2 * depth * sqrt(1 + bank_slope * bank_slope), 2.0/3)), 5) q,
      round(hc, 9) critical_depth,
      round(power(hc * (base_width + bank_slope * hc), 5.0/3) * sqrt(slope) / (n * power(base_width + 2 * hc * sqrt(1 + bank_slope * bank_slope), 2.0/3)), 5) critical_q,
      round(base_width * (3.13 + 3.25 + 5.4 + 6.51 + 6.7) / 5, 5) spacing, round(base_width * 3.13, 5) spacing_low, round(base_width * 6.7, 5) spacing_high
    from a""",
)
def channel_functions(d: Data):
    reaches = d.spark.sql(REACHES, part=d.table("part")).withColumn("n", channel.strickler_n("d50"))
    bounds = channel.pool_spacing_bounds("base_width")
    out = reaches.select(
        "reach_id",
        F.col("n").alias("strickler"),
        channel.meyer_peter_mueller_n(F.col("d50") * 2.75).alias("mpm"),
        channel.variable_power_n("depth", F.col("d50") * 2.2).alias("rr"),
        channel.trapezoid_discharge("depth", "bank_slope", "n", "base_width", "slope").alias("q"),
        channel.transport_depth("d50", "slope").alias("critical_depth"),
        channel.transport_discharge("d50", "slope", "bank_slope", "n", "base_width").alias("critical_q"),
        channel.pool_spacing("base_width").alias("spacing"),
        bounds["low"].alias("spacing_low"),
        bounds["high"].alias("spacing_high"),
    )
    return rounded(out, critical_depth=9, q=5, critical_q=5, spacing=5, spacing_low=5, spacing_high=5)


@query(
    "normal_depth",
    f"with reaches as ({REACHES.format(part='part')}) select reach_id, round(depth, 5) depth, round(base_width, 5) width from reaches",
)
def normal_depth(d: Data):
    reaches = d.spark.sql(REACHES, part=d.table("part")).withColumn("n", channel.strickler_n("d50"))
    reaches = reaches.withColumn("q", channel.trapezoid_discharge("depth", "bank_slope", "n", "base_width", "slope"))
    back = channel.normal_depth_udf()("q", "bank_slope", "n", "base_width", "slope")
    width = channel.base_width_udf()("q", "depth", "bank_slope", "n", "slope")
    return rounded(reaches.select("reach_id", back.alias("depth"), width.alias("width")), 5)


@query("design_pool_riffle")
def design(d: Data):
    from ..plans.channels import design_pool_riffle

    reaches = d.spark.sql(REACHES, part=d.table("part")).withColumn("target_depth", F.col("depth") / 3.0)
    return rounded(design_pool_riffle(reaches.drop("depth")))


