"""Layer stores, condition metadata and parameter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.naming import short_code
from ..plans import cost as cost_plan
from ..session import scratch_path
from ..sources import definitions, flow, layers, lookup, textgrids
from .registry import Data, query, rounded, sql

LONG = """l_v as (select 'dem' layer, r, c, z v from cells_v union all select 'd2w', r, c, case when k7 = 0 then -999.0 else d2w end from cells_v
  union all select 'dmean', r, c, case when mu = 3 then 0.0 else dmean end from cells_v union all select 'wood', r, c, cast(k7 as double) from cells_v)"""


def long_cells(d: Data):
    """Four layers in long form; ``d2w`` carries -999 and ``dmean`` 0 as NoData."""
    pairs = [("dem", F.col("z")), ("d2w", F.when(F.col("k7") == 0, F.lit(-999.0)).otherwise(F.col("d2w")))]
    pairs += [("dmean", F.when(F.col("mu") == 3, F.lit(0.0)).otherwise(F.col("dmean"))), ("wood", F.col("k7").cast("double"))]
    parts = F.array(*[F.struct(F.lit(n).alias("layer"), v.alias("v")) for n, v in pairs])
    return d.cells.select("r", "c", F.explode(parts).alias("s")).select("s.layer", "r", "c", "s.v")


@query("read_layer", sql("cells_v", ctes=LONG, body="select r, c, v from l_v where layer = 'd2w' and v <> -999"))
def read_layer(d: Data):
    return layers.read_layer(long_cells(d), "d2w", K.NODATA)


GRIDS = """select layer, 3.0 x0, 7.0 y0, 2.0 dx, 1.5 dy, cast(max(r) + 1 as int) nrows, 128 ncols from l_v group by layer"""


def stored_grids(d: Data):
    """The four layers written as text grids and read back."""
    cells = long_cells(d)
    profiles = cells.groupBy("layer").agg((F.max("r") + 1).cast("int").alias("nrows"), F.lit(128).alias("ncols"))
    profiles = profiles.withColumns({"x0": F.lit(3.0), "y0": F.lit(7.0), "dx": F.lit(2.0), "dy": F.lit(1.5)})
    path = scratch_path(d.spark)
    textgrids.write_text_grids(cells, profiles, path)
    return textgrids.read_text_grids(d.spark, path)


@query("text_grids", sql("cells_v", ctes=LONG, body="select layer, r, c, v from l_v where v <> -999"))
def text_grids(d: Data):
    return stored_grids(d)[0]


@query("text_grid_headers", sql("cells_v", ctes=LONG, body=GRIDS))
def text_grid_headers(d: Data):
    return stored_grids(d)[1].drop("crs")


@query("stored_layers", sql("cells_v", ctes=LONG, body="select layer, r, c, v from l_v where layer in ('dem', 'wood')"))
def stored_layers(d: Data):
    """Layers written to a store and read back with the other partitions pruned."""
    path = scratch_path(d.spark)
    layers.write_layers(long_cells(d), path)
    return layers.read_layers(d.spark, path, ["dem", "wood"]).select("layer", "r", "c", "v")


@query(
    "grid_profiles",
    """with c as (select o_orderpriority condition, max(cast(floor(o_orderkey/128.0) as int)) + 1 nrows, max(cast(o_orderkey % 128 as int)) + 1 ncols from orders group by 1)
    select condition, nrows, ncols, 5.0 x0, 7.0 y0, 3.0 dx, 2.0 dy, 'local' crs from c""",
)
def grid_profiles(d: Data):
    cells = d.table("orders").select(
        F.col("o_orderpriority").alias("condition"),
        F.floor(F.col("o_orderkey") / 128).cast("int").alias("r"),
        (F.col("o_orderkey") % 128).cast("int").alias("c"),
    )
    return layers.grid_profiles(cells, 3.0, 2.0, 5.0, 7.0, "local", keys=("condition",))


@query("cell_size", "select o_orderkey grid, cast(1 + o_orderkey % 5 as double) dx, cast(2 + o_orderkey % 3 as double) dy from orders")
def cell_size(d: Data):
    from ..grid import cell_size as sizes

    key = F.col("o_orderkey")
    grids = d.table("orders").select(key.alias("grid"), (1 + key % 5).cast("double").alias("dx"), (-2 - key % 3).cast("double").alias("dy"))
    return sizes(grids)


@query("encode_layer", sql("cells_v", body="select r, c, cast(case when k7 = 0 then -999 else z end as float) v from cells_v"))
def encode_layer(d: Data):
    return layers.encoded(d.cells.select("r", "c", F.when(F.col("k7") > 0, F.col("z")).alias("v")))


@query("list_layers", sql("catalog_v", body="select distinct condition, name as layer from catalog_v where name like 'h0%.tif' order by 1, 2"))
def list_layers(d: Data):
    return layers.list_layers(d.view("catalog_v").withColumnRenamed("name", "layer"), "h0*.tif", ["condition"])


HYD = """hl_v as (select condition, substr(name, 1, 1) kind, name, cast(replace(regexp_extract(name, '\\d+(_\\d+)?'), '_', '.') as double) q
  from catalog_v where regexp_matches(name, '^[hu]\\d+(_\\d+)?\\.tif$'))"""


@query(
    "discover_discharges",
    sql("catalog_v", ctes=HYD, body="select *, cast(row_number() over (partition by condition order by q, name) - 1 as int) pos from hl_v where kind = 'h'"),
)
def discover(d: Data):
    return definitions.discover_discharges(d.view("catalog_v"))


@query("paired_discharges", sql("catalog_v", ctes=HYD, body="select condition, q from hl_v where kind = 'h' intersect select condition, q from hl_v where kind = 'u'"))
def paired(d: Data):
    return definitions.paired_discharges(d.view("catalog_v"))


@query(
    "unpaired_discharges",
    sql("catalog_v", ctes=HYD, body="select condition, q from hl_v where kind = 'h' except select condition, q from hl_v where kind = 'u'"),
)
def unpaired(d: Data):
    found = definitions.hydraulic_layers(d.view("catalog_v")).select("condition", "kind", "q").distinct()
    return found.filter("kind = 'h'").drop("kind").join(found.filter("kind = 'u'"), ["condition", "q"], "left_anti")


@query(
    "layer_for_discharge",
    sql("catalog_v", ctes=HYD, body="select condition, q, min(name) name from hl_v where kind = 'h' and abs(q - 13.2) < 1e-6 group by 1, 2"),
)
def layer_for(d: Data):
    return definitions.layer_for(d.view("catalog_v"), "h", 13.2)


KEY_CASE = " ".join(f"when contains(k, '{text}') then '{name}'" for text, name in sorted(K.DEFINITION_KEYS, key=lambda row: -len(row[0])))
PARSED = f"""
  p1_v as (select condition, line_no, trim(split_part(line, '#', 1)) b from lines_v),
  p2_v as (select condition, line_no, lower(trim(split_part(b, '=', 1))) k, trim(substr(b, instr(b, '=') + 1)) raw from p1_v where instr(b, '=') > 0),
  p3_v as (select condition, case {KEY_CASE} end attribute, raw, line_no from p2_v where raw <> ''),
  p4_v as (select condition, attribute, arg_max(raw, line_no) raw from p3_v where attribute is not null group by 1, 2),
  p5_v as (select condition, attribute, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') items from p4_v),
  p6_v as (select condition, attribute, case when attribute like '%\\_rasters' escape '\\' or attribute = 'return_periods' then items else items[1:1] end items from p5_v),
  defs_v as (select condition, attribute, cast(generate_subscripts(items, 1) - 1 as int) pos, unnest(items) item from p6_v)"""


@query("parse_definitions", sql("lines_v", ctes=PARSED, body="select * from defs_v"))
def parse(d: Data):
    return definitions.parse_definitions(d.view("lines_v"))


def catalog_for(d: Data):
    """Layers that exist for the parsed conditions (some of those named, plus others)."""
    return d.spark.sql(CATALOG.format(orders="{orders}"), orders=d.table("orders"))


CATALOG = """select distinct cast(o_custkey as int) condition,
  case cast(o_orderkey % 5 as int) when 0 then concat('h', printf('%06d', cast(o_custkey % 40 as bigint)), '.tif')
    when 1 then concat('u', printf('%06d', cast(o_custkey % 40 as bigint)), '.tif') when 2 then 'h000100_500.tif'
    when 3 then 'u000100_500.tif' else concat('dem', cast(o_custkey % 4 as varchar(9)), '.tif') end name from {orders}"""
PAIRS = (
    "cat_v as ("
    + CATALOG.format(orders="orders")
    + """),
  hq_v as (select condition, substr(name, 1, 1) kind, name, cast(replace(regexp_extract(name, '\\d+(_\\d+)?'), '_', '.') as double) q from cat_v where name not like 'dem%'),
  nm_v as (select distinct condition from defs_v where attribute = 'depth_rasters'),
  ds_v as (select condition, kind, name, cast(row_number() over (partition by condition, kind order by q, name) - 1 as int) pos from hq_v where condition not in (select condition from nm_v)),
  dp_v as (select condition, pos, item from defs_v where attribute = 'depth_rasters' union all select condition, pos, name from ds_v where kind = 'h'),
  ve_v as (select condition, pos, item from defs_v where attribute = 'velocity_rasters' and condition in (select condition from nm_v) union all select condition, pos, name from ds_v where kind = 'u'),
  pe_v as (select condition, pos, try_cast(item as double) period from defs_v where attribute = 'return_periods'),
  pr_v as (select d.condition, d.pos, d.item depth, v.item velocity, cast(replace(regexp_extract(d.item, '\\d+(_\\d+)?'), '_', '.') as double) q from dp_v d join ve_v v using (condition, pos)),
  pt_v as (select p.*, case when p.condition in (select condition from pe_v) then e.period else q end period from pr_v p left join pe_v e using (condition, pos))"""
)


@query(
    "hydraulic_pairs",
    sql(
        "lines_v",
        ctes=PARSED + "," + PAIRS,
        body="""select condition, pos, period, depth, velocity, q from pt_v where period is not null and (condition, depth) in (select (condition, name) from cat_v)
          and (condition, velocity) in (select (condition, name) from cat_v)""",
    ),
)
def pairs(d: Data):
    return definitions.hydraulic_pairs(definitions.parse_definitions(d.view("lines_v")), catalog_for(d))


@query(
    "max_lifespan",
    sql("lines_v", ctes=PARSED, body="select condition, coalesce(max(case when attribute = 'return_periods' then try_cast(item as double) end), 50.0) max_lifespan from defs_v group by 1"),
)
def max_lifespan(d: Data):
    return definitions.max_lifespan(definitions.parse_definitions(d.view("lines_v")))


@query(
    "validate_conditions",
    sql(
        "lines_v",
        ctes=PARSED
        + ","
        + PAIRS
        + """, al_v as (select condition from cat_v union select condition from defs_v),
          ex_v as (select condition, attribute, case when regexp_matches(item, '\\.[^.]+$') then item else item || '.tif' end item from defs_v)""",
        body="""select condition, 'no definitions' problem, '' detail from al_v where condition not in (select condition from defs_v)
          union all select condition, 'no depth layer', '' from al_v where condition not in (select condition from hq_v where kind = 'h')
          union all select condition, 'no velocity layer', '' from al_v where condition not in (select condition from hq_v where kind = 'u')
          union all select condition, 'depth without velocity', case when q = floor(q) then cast(cast(q as bigint) as varchar) else rtrim(printf('%.4f', q), '0') end
            from (select condition, q from hq_v where kind = 'h' except select condition, q from hq_v where kind = 'u')
          union all select condition, 'velocity without depth', case when q = floor(q) then cast(cast(q as bigint) as varchar) else rtrim(printf('%.4f', q), '0') end
            from (select condition, q from hq_v where kind = 'u' except select condition, q from hq_v where kind = 'h')
          union all select a.condition, 'missing dem', coalesce(e.item, 'dem.tif') from al_v a left join ex_v e on e.condition = a.condition and attribute = 'dem_raster'
            where (a.condition, coalesce(e.item, 'dem.tif')) not in (select (condition, name) from cat_v)
          union all select a.condition, 'missing dmean', coalesce(e.item, 'dmean.tif') from al_v a left join ex_v e on e.condition = a.condition and attribute = 'grain_raster'
            where (a.condition, coalesce(e.item, 'dmean.tif')) not in (select (condition, name) from cat_v)
          union all select condition, 'named but absent', item from ex_v where attribute in ('depth_rasters', 'velocity_rasters') and (condition, item) not in (select (condition, name) from cat_v)""",
    ),
)
def validate(d: Data):
    return definitions.validate(definitions.parse_definitions(d.view("lines_v")), catalog_for(d))


@query(
    "describe_conditions",
    sql(
        "catalog_v",
        ctes=HYD,
        body="""select condition, count(case when kind = 'h' then 1 end) depth_layers, min(case when kind = 'h' then q end) depth_q_min, max(case when kind = 'h' then q end) depth_q_max,
          count(case when kind = 'u' then 1 end) velocity_layers, min(case when kind = 'u' then q end) velocity_q_min, max(case when kind = 'u' then q end) velocity_q_max,
          coalesce(string_agg(distinct case when name in ('dem.tif', 'dmean.tif') then replace(name, '.tif', '') end, ', ' order by case when name in ('dem.tif', 'dmean.tif') then replace(name, '.tif', '') end), '') other_layers
        from catalog_v left join hl_v using (condition, name) group by 1""",
    ),
)
def describe(d: Data):
    return definitions.describe(d.view("catalog_v"))


@query(
    "definition_lines",
    sql(
        "catalog_v",
        ctes=HYD
        + """, q_v as (select condition, q, name, replace(printf('%010.3f', q), '.', '_') f from hl_v where kind = 'h'),
          t_v as (select condition, string_agg(name, ', ' order by q, name) h,
            string_agg('u' || case when q = floor(q) then printf('%06d', cast(q as bigint)) else f end || '.tif', ', ' order by q, name) u from q_v group by 1)""",
        body="""select condition, cast(i as int) line_no, case i when 0 then 'Return periods =  # list of years, one per discharge' when 1 then 'Water depth (h) = ' || h || ' # list'
          when 2 then 'Flow velocity (u) = ' || u || ' # list' when 3 then 'Grain sizes (D mean) = d50 # name' when 4 then 'Detrended DEM = dem_detrend # name'
          when 5 then 'Depth to groundwater table (d2w) = d2w # name' when 6 then 'Morphological units (mu) = mu # name' when 7 then 'DEM = dem # name'
          else 'DEM of differences = fill, scour # list' end line from t_v, range(0, 9) x(i)""",
    ),
)
def lines(d: Data):
    known = definitions.discover_discharges(d.view("catalog_v")).select("condition", "q", F.col("name").alias("depth"))
    return definitions.definition_lines(known, names={"grain": "d50"})


FLOW_TEXT = """select o_orderkey row_no, case when o_orderkey % 97 = 0 then 'n/a' when o_orderkey % 89 = 0 then null else cast(cast(o_orderdate as date) as varchar(20)) end date_text,
  case when o_orderkey % 83 = 0 then 'cfs' else cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) end q_text from {orders}"""


@query(
    "clean_flow",
    f"""with t as ({FLOW_TEXT.format(orders='orders')}) select cast(date_text as date) d, arg_max(cast(q_text as double), row_no) q
    from t where try_cast(date_text as date) is not null and try_cast(q_text as double) is not null group by 1""",
)
def clean(d: Data):
    return flow.clean_flow(d.spark.sql(FLOW_TEXT, orders=d.table("orders")))


@query(
    "thin_duration_curve",
    sql(
        "gauge_flow_v",
        ctes="""r_v as (select gauge, d, q, cast(row_number() over (partition by gauge order by q desc, d) as int) rank, count(*) over (partition by gauge) n from gauge_flow_v),
          k_v as (select distinct n, cast(floor(i * ((n - 1) / 39.0)) as bigint) i from (select distinct n from r_v), range(0, 40) x(i) where n > 40 union select n, n - 1 from r_v where n > 40)""",
        body="select gauge, rank, round(q, 6) q, round(rank / n * 100, 6) exceedance from r_v where n <= 40 or (n, rank - 1) in (select (n, i) from k_v)",
    ),
)
def thin(d: Data):
    curve = flow.numbered_curve(d.gauges, ["gauge"])
    return rounded(flow.thin_curve(curve, 40, ["gauge"]).select("gauge", "rank", "q", "exceedance"))


@query(
    "stored_duration",
    sql("gauge_flow_v", body="select gauge, q, row_number() over (partition by gauge order by q desc, d) / count(*) over (partition by gauge) * 100.0 exceedance from gauge_flow_v"),
)
def stored_duration(d: Data):
    """Duration curves written one folder a gauge and read back."""
    path = scratch_path(d.spark)
    flow.write_duration(flow.numbered_curve(d.gauges, ["gauge"]), path, keys=["gauge"])
    return flow.read_duration(d.spark.read.parquet(path), ["gauge"])


DURATION = """select o_orderkey row_no, case when o_orderkey % 11 = 0 then 'Q' else cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) end q,
  case when o_orderkey % 13 = 0 then '-' when o_orderkey % 17 = 0 then null else cast(o_orderkey % 100 as varchar(9)) end exceedance from {orders}"""


@query("read_duration", f"""select row_no, cast(q as double) q, cast(exceedance as double) exceedance from ({DURATION.format(orders='orders')}) where try_cast(q as double) is not null and try_cast(exceedance as double) is not null""")
def read_duration(d: Data):
    return flow.read_duration(d.spark.sql(DURATION, orders=d.table("orders")), ["row_no"])


THRESHOLDS = """select concat('f', cast(p_partkey as varchar(9))) fid, p_name name, p_brand grp, cast(p_partkey as varchar(9)) ord,
  case when p_size % 3 = 0 then 'n/a' else concat('0.0', cast(p_size % 9 as varchar(9))) end tau_cr, cast(p_size % 2 as varchar(2)) inverse_tcd,
  concat('bank, NA ,', p_type, ', ') mu_relevant, cast(p_size % 2 as varchar(2)) mu_method from {part}"""


@query(
    "features_from_table",
    f"""select fid, grp, cast(ord as int) ord, try_cast(tau_cr as double) tau_cr, inverse_tcd = '1' inverse_tcd, 'bank|' || trim(split_part(mu_relevant, ',', 3)) mu, cast(mu_method as int) mu_method,
    true lifespan_mapping from ({THRESHOLDS.format(part='part')})""",
)
def features(d: Data):
    table = lookup.features_from_table(d.spark.sql(THRESHOLDS, part=d.table("part")))
    return table.select("fid", "grp", "ord", "tau_cr", "inverse_tcd", F.array_join("mu_relevant", "|").alias("mu"), "mu_method", "lifespan_mapping")


@query(
    "feature_groups",
    f"select grp, min(cast(ord as int)) over (partition by grp) \"first\", cast(ord as int) ord, fid from ({THRESHOLDS.format(part='part')})",
)
def groups(d: Data):
    return lookup.feature_groups(lookup.features_from_table(d.spark.sql(THRESHOLDS, part=d.table("part"))))


@query("planting_limits", f"select grp, coalesce(min(case when size % 4 = 0 then size end), 10.0) d2w_max from (select p_brand grp, cast(p_size as double) size from part) group by grp")
def limits(d: Data):
    table = d.table("part").select(F.col("p_brand").alias("grp"), F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("double")).alias("d2w_max"))
    return lookup.planting_limits(table)


CURVES = """select concat(p_brand, ' ', cast(floor(p_partkey / 60.0) as int)) species, p_type lifestage, case when p_size % 2 = 0 then 'h' else 'u' end param, cast(p_partkey as int) pt,
  cast(p_size / 4.0 as double) x, case when p_partkey % 31 = 0 then null else cast((p_partkey % 11) / 10.0 as double) end y from {part}"""


@query(
    "curve_arrays",
    f"""with t as ({CURVES.format(part='part')}), g as (select species, lifestage, param, min(case when y is null then pt end) gap from t group by 1, 2, 3),
    k as (select t.* from t join g using (species, lifestage, param) where gap is null or pt < gap)
    select species, lifestage, param, count(*) points, round(min(x), 6) x_first, round(sum(x * y), 6) xy, round(arg_min(y, struct_pack(x := x, y := y)), 6) y_first from k group by 1, 2, 3 having count(*) >= 2""",
)
def curves(d: Data):
    arrays = lookup.curve_arrays(d.spark.sql(CURVES, part=d.table("part")))
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"] * p["y"])
    return rounded(
        arrays.select(
            "species", "lifestage", "param", F.size("points").cast("bigint").alias("points"), F.col("points")[0]["x"].alias("x_first"), total.alias("xy"), F.col("points")[0]["y"].alias("y_first")
        )
    )


@query(
    "recruitment_defaults",
    """select p_partkey, coalesce(case when p_size % 3 > 0 then p_size % 12 + 1 end, 5) seed_start_m, 2 seed_start_d, coalesce(case when p_size % 4 > 0 then p_size / 100.0 end, 0.047) tau_cr_full,
      case when p_size % 5 > 0 then p_name else 'unnamed' end species, 28 inundation_lethal, cast(null as double) band_lower from part""",
)
def recruitment_defaults(d: Data):
    size = F.col("p_size")
    table = d.table("part").select(
        "p_partkey",
        F.when(size % 3 > 0, (size % 12 + 1).cast("string")).otherwise("x").alias("seed_start_m"),
        F.when(size % 4 > 0, size / 100.0).alias("tau_cr_full"),
        F.when(size % 5 > 0, F.col("p_name")).alias("species"),
    )
    out = lookup.recruitment_defaults(table)
    return out.select("p_partkey", "seed_start_m", "seed_start_d", "tau_cr_full", "species", "inundation_lethal", "band_lower")


@query(
    "reconcile_nodata",
    sql(
        "cells_v",
        ctes=LONG,
        body="""select layer, max(case layer when 'd2w' then -999.0 when 'dmean' then 0.0 end) nodata, count(case when (layer = 'd2w' and v = -999) or (layer = 'dmean' and v = 0) then 1 end) before,
          count(case when (layer = 'd2w' and v = -999) or (layer = 'dmean' and v = 0) then 1 end) after, case layer when 'd2w' then 'unchanged' when 'dmean' then 'rewritten' else 'declared only' end status from l_v group by layer""",
    ),
)
def reconcile(d: Data):
    declared = d.values([("d2w", -999.0), ("dmean", 0.0)], "layer string, nodata double")
    return layers.reconcile_report(long_cells(d), declared)


@query("reconciled_layers", sql("cells_v", ctes=LONG, body="select layer, r, c, case when (layer = 'd2w' and v = -999) or (layer = 'dmean' and v = 0) then null else round(v, 6) end v from l_v"))
def reconciled(d: Data):
    declared = d.values([("d2w", -999.0), ("dmean", 0.0)], "layer string, nodata double")
    return rounded(layers.reconcile_nodata(long_cells(d), declared))


def masks(d: Data):
    """Feature masks ``best_f<mu % 5>`` and ``lf_g``; value 0 marks cells outside."""
    cells = d.cells
    best = cells.select(F.concat(F.lit("best_f"), F.col("mu") % 5).alias("layer"), "r", "c", (F.col("k7") % 3).cast("double").alias("v"))
    return best.unionByName(cells.filter("mu < 9").select(F.lit("lf_g").alias("layer"), "r", "c", F.lit(2.0).alias("v")))


MASKS = """m_v as (select concat('best_f', mu % 5) layer, r, c, cast(k7 % 3 as double) v from cells_v union all select 'lf_g', r, c, 2.0 from cells_v where mu < 9)"""


@query(
    "action_masks",
    sql("cells_v", ctes=MASKS, body="select layer, r, c, v, regexp_replace(layer, '^(best_|lf_|ds_)', '') fid, cast(case layer when 'lf_g' then 0 when 'best_f3' then 1 else 2 end as int) ord from m_v where v > 0 and layer in ('lf_g', 'best_f3', 'best_f1')"),
)
def action_masks(d: Data):
    return layers.action_masks(masks(d), ["g", "f3", "f1"])


@query(
    "velocity_components",
    sql(
        "hydraulics_v",
        ctes="k_v as (select q, r, c, case when u > 2 and q <> 3000 then ux end ux, case when u > 1 and q <> 5000 then uy end uy from hydraulics_v)",
        body="select q, r, c, coalesce(ux, 0) ux, coalesce(uy, 0) uy from k_v where q in (select q from k_v group by q having count(ux) > 0 and count(uy) > 0)",
    ),
)
def components(d: Data):
    some = d.hydraulics.select(
        "q", "r", "c", F.when((F.col("u") > 2) & (F.col("q") != 3000), F.col("ux")).alias("ux"), F.when((F.col("u") > 1) & (F.col("q") != 5000), F.col("uy")).alias("uy")
    )
    return layers.velocity_components(some)


@query(
    "cover_layers",
    sql("cells_v", ctes=LONG, body="select case layer when 'dmean' then 'substrate' else layer end cover, r, c, round(v, 6) v from l_v where layer = 'dmean' union all select 'wood', r, c, 1.0 from cells_v where z > 90"),
)
def cover_layers(d: Data):
    extra = d.cells.filter("z > 90").select(F.lit("wood").alias("cover"), "r", "c", F.lit(1.0).alias("v"))
    return rounded(layers.cover_layers(long_cells(d), "dmean", extra))


NAMES = """select c_custkey, concat('  ', upper(c_mktsegment), case when c_custkey % 2 = 0 then '   ' else '' end) species, case when c_custkey % 3 = 0 then ' Fry' when c_custkey % 3 = 1 then 'JUVENILE ' else 'smolt' end lifestage from {customer}"""


@query(
    "resolve_names",
    f"""with a as ({NAMES.format(customer='customer')}), k as (select distinct c_mktsegment s, l from customer, (values ('fry'), ('juvenile')) t(l))
    select c_custkey, species, lifestage, s known_species, l known_lifestage, lower(substr(species, 1, 2)) || lower(substr(lifestage, 1, 2)) code from a left join k on lower(trim(species)) = lower(s) and lower(trim(lifestage)) = l""",
)
def resolve(d: Data):
    customer = d.table("customer")
    stages = F.explode(F.array(F.lit("fry"), F.lit("juvenile"))).alias("lifestage")
    known = customer.select(F.col("c_mktsegment").alias("species"), stages)
    found = lookup.resolve_names(d.spark.sql(NAMES, customer=customer), known)
    return found.select("c_custkey", "species", "lifestage", "known_species", "known_lifestage", short_code("species", "lifestage").alias("code"))


@query(
    "travel_thresholds",
    """select c_custkey, case when c_custkey % 2 = 0 then 'CHINOOK  salmon' else 'Trout' end species, case when c_custkey % 4 < 2 then 'Fry' else 'adult' end lifestage,
      case when c_custkey % 2 = 1 then 0.4 when c_custkey % 4 < 2 then 0.25 else 0.9 end h_min, case when c_custkey % 2 = 1 then null when c_custkey % 4 < 2 then 1.9 else 11.0 end u_max from customer""",
)
def thresholds(d: Data):
    key = F.col("c_custkey")
    asked = d.table("customer").select(
        "c_custkey", F.when(key % 2 == 0, "CHINOOK  salmon").otherwise("Trout").alias("species"), F.when(key % 4 < 2, "Fry").otherwise("adult").alias("lifestage")
    )
    table = d.values(
        [("Chinook Salmon", "fry", 0.25, None), ("trout", "fry", 0.4, None), ("trout", "adult", 0.4, None)], "species string, lifestage string, h_min double, u_max double"
    )
    return lookup.travel_thresholds(asked, table)


# ---- costs: one project per customer, features from the customer's orders

SOURCES = """select cast(o_custkey as bigint) project, case cast(o_orderkey % 6 as int) when 0 then 'wood' when 1 then 'cot' when 2 then 'rocks' when 3 then 'gravin' when 4 then 'terraforming_area' else 'earthworks_volume' end source,
  cast(sum(cast(round(o_totalprice * 100) as bigint)) / 100.0 as double) amount from {orders} group by 1, 2"""
QUANT = f"""src_v as ({SOURCES.format(orders='orders')}),
  item_v as (select * from (values ('streamwood', 'wood', 'log', 775.0, 'Stabilising bioengineering', 'Streamwood (non-anchored)'), ('pod_cottonwood', 'cot', 'acre', 72447.5, 'Vegetation plantings', 'Pod method (Cottonwood)'),
    ('boulders', 'rocks', 'sq yard', 150.0, 'Stabilising bioengineering', 'Angular boulder placement (instream)'), ('gravel', 'gravin', 'yard', 1500.0, 'Maintenance', 'Gravel (spawning substrate)'),
    ('clearing', 'terraforming_area', 'acre', 220.0, 'Terraforming', 'Clearing (vegetation)'), ('earthworks', 'earthworks_volume', 'cubic yard', 23.0, 'Terraforming', 'Excavate/fill alluvial material (incl. transport)')) t(key, source, per, rate, grp, task)),
  q_v as (select project, key, per, rate, grp, task, case key when 'streamwood' then amount / 625 when 'pod_cottonwood' then amount / 43560 when 'boulders' then amount / 9 when 'clearing' then amount / 43560 when 'earthworks' then amount / 27 end quantity
    from src_v join item_v using (source)),
  b_v as (select project, key, per, rate, grp, task, coalesce(quantity, 0) quantity, coalesce(quantity, 0) * rate as cost from q_v),
  c_v as (select project, sum(cost) construction from b_v group by 1),
  f_v as (select * from (values (0, 'mobilisation', 'Site (de-)mobilization', 0.10, 0.1), (1, 'contingency', 'Unexpected', 0.10, 0.11), (2, 'markups', 'Markups (overhead, profit, insurance)', 0.165, 0.19965), (3, 'permitting', 'Permitting', 0.35, 0.4933775)) t(pos, key, label, fraction, share)),
  a_v as (select project, pos, key, label, fraction, construction * share as amount from c_v, f_v)"""


def sources_table(d: Data):
    return d.spark.sql(SOURCES, orders=d.table("orders"))


def bill_lines(d: Data):
    return cost_plan.bill(cost_plan.quantities(sources_table(d)))


@query("cost_quantities", "with " + QUANT + " select project, key, per, round(quantity, 4) quantity from q_v")
def cost_quantities(d: Data):
    return rounded(cost_plan.quantities(sources_table(d)), 4)


@query("bill_of_quantities", "with " + QUANT + " select project, grp, round(sum(cost), 2) as cost from b_v group by 1, 2")
def bill_query(d: Data):
    return rounded(cost_plan.group_sums(bill_lines(d)), 2)


@query("applied_rates", "with " + QUANT + " select project, pos, key, label, round(fraction, 4) fraction, round(amount, 2) amount from a_v")
def rates(d: Data):
    return rounded(cost_plan.applied_rates(cost_plan.construction(bill_lines(d))), 2, fraction=4)


GAIN = """g_v as (select cast(o_custkey as bigint) project, sum(case when o_orderkey % 2 = 0 then o_totalprice else 0 end) before, sum(case when o_orderkey % 2 = 1 then o_totalprice else 0 end) after from orders group by 1)"""


def gains(d: Data):
    side = lambda odd: F.sum(F.when(F.col("o_orderkey") % 2 == odd, F.col("o_totalprice")).otherwise(0.0)).alias("sharea")
    per = d.table("orders").withColumn("project", F.col("o_custkey").cast("bigint")).groupBy("project")
    return cost_plan.habitat_gain(per.agg(side(0)), per.agg(side(1)))


@query(
    "habitat_gain",
    f"with {GAIN} select project, round(before, 2) before, round(after, 2) after, round(after - before, 2) gain, case when before = 0 then cast('inf' as double) else round((after - before) / before, 6) end relative from g_v",
)
def gain_query(d: Data):
    return rounded(gains(d), 2, relative=6)


@query(
    "cost_benefit",
    f"with {QUANT}, {GAIN} select project, round(construction, 2) construction, round(construction * 1.9030275, 2) total, round(after - before, 2) gain, case when after > before then round(construction * 1.9030275 / (after - before), 5) end cost_per_area from c_v join g_v using (project)",
)
def benefit(d: Data):
    totals = cost_plan.grand_total(cost_plan.construction(bill_lines(d)))
    out = cost_plan.cost_benefit(totals, gains(d)).select("project", "construction", "total", "gain", "cost_per_area")
    return rounded(out, 2, cost_per_area=5)


@query(
    "cost_report",
    f"""with {QUANT}, {GAIN}, x_v as (
      select project, grp section, task item, quantity, per, rate, cost from b_v where quantity <> 0
      union all select project, 'UNQUANTIFIED', task, null, per, rate, null from q_v where quantity is null
      union all select project, 'SUM', grp, null, '', null, sum(cost) from b_v group by project, grp having sum(cost) <> 0
      union all select project, 'SUM', 'TOTAL CONSTRUCTION WORKS', null, '', null, construction from c_v
      union all select project, 'RATE', label, null, '', null, amount from a_v
      union all select project, 'TOTAL', '', null, '', null, construction * 1.9030275 from c_v
      union all select project, 'HABITAT', 'SHArea before', before, '', null, null from c_v join g_v using (project)
      union all select project, 'HABITAT', 'SHArea after', after, '', null, null from c_v join g_v using (project)
      union all select project, 'HABITAT', 'net gain', after - before, '', null, null from c_v join g_v using (project)
      union all select project, 'HABITAT', 'cost per area gained', null, '', null, construction * 1.9030275 / (after - before) from c_v join g_v using (project) where after > before)
    select project, section, item, case section when 'RATE' then case item when 'Permitting' then 35.0 when 'Unexpected' then 10.0 when 'Site (de-)mobilization' then 10.0 else 16.5 end else round(quantity, 3) end quantity,
      per, round(rate, 2) rate, round(cost, 2) as cost from x_v""",
)
def cost_report(d: Data):
    return rounded(cost_plan.report(bill_lines(d), gains=gains(d)), 2, quantity=3)


